"""Neighbour similarity: two entities are alike when their neighbours are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import ids, scores
from linkloom.operators.shared_top_k import EFFORT, PROBES, best_first, keep_top, link_posts, top_partners
from linkloom.runtime import materialize

#: Entities with at most so many neighbours are folded with those that have the same.
FOLDED = 16


def _degrees(in_neighbors: DataFrame, key: str, count: str) -> DataFrame:
    return in_neighbors.groupBy(F.col("entity_id").alias(key)).agg(F.count(F.lit(1)).alias(count))


def neighbor_links(value_candidates: DataFrame, in_neighbors: DataFrame, combine: str = "sum") -> DataFrame:
    """``(d2_id, d1_id, weight, n1, n2)``: candidate pairs that have in-neighbours on both ends.

    ``weight`` is the similarity in fixed point.  A pair that both entities
    list as a candidate counts twice in a sum.  ``n1`` and ``n2`` are the
    numbers of in-neighbours, so ``n1 * n2`` pairs of in-neighbours inherit
    the weight.
    """
    folded = F.max("weight") if combine == "max" else F.sum("weight")
    return (
        value_candidates.select(
            F.least("entity_id", "cand_id").alias("d2_id"),
            F.greatest("entity_id", "cand_id").alias("d1_id"),
            scores.to_fixed(F.col("score")).alias("weight"),
        )
        .groupBy("d2_id", "d1_id")
        .agg(folded.alias("weight"))
        .join(_degrees(in_neighbors, "d1_id", "n1"), "d1_id")
        .join(_degrees(in_neighbors, "d2_id", "n2"), "d2_id")
    )


def neighbor_pairs(value_candidates: DataFrame, in_neighbors: DataFrame) -> DataFrame:
    """Every pair of in-neighbours of every candidate edge: ``(entity_id, cand_id, sim)``.

    Both directions are listed.  The result is as large as the products of the
    in-degrees; the top-K operators do not use it.
    """
    mine = in_neighbors.select("entity_id", F.col("in_id").alias("x"))
    theirs = in_neighbors.select(F.col("entity_id").alias("cand_id"), F.col("in_id").alias("y"))
    pairs = value_candidates.join(mine, "entity_id").join(theirs, "cand_id")
    forward = F.struct(F.col("x").alias("entity_id"), F.col("y").alias("cand_id"))
    backward = F.struct(F.col("y").alias("entity_id"), F.col("x").alias("cand_id"))
    return pairs.select(F.explode(F.array(forward, backward)).alias("e"), F.col("score").alias("sim")).select(
        "e.entity_id", "e.cand_id", "sim"
    )


def top_neighbor_candidates(
    value_candidates: DataFrame,
    in_neighbors: DataFrame,
    k: int,
    combine: str = "sum",
    *,
    effort: int = EFFORT,
    probes: int = PROBES,
) -> DataFrame:
    """Top-K candidates by neighbour similarity: ``(entity_id, cand_id, score, rank)``.

    combine -- ``sum`` or ``max`` of the value similarities of the neighbours
    effort, probes -- as in `top_partners`
    """
    if combine not in ("sum", "max"):
        raise ValueError("combine must be 'sum' or 'max'")
    classes = materialize(_alike(in_neighbors), "neighbor-classes")
    folded = materialize(
        in_neighbors.join(classes.where("class_id = entity_id").select(F.col("entity_id").alias("in_id")), "in_id")
        .select("entity_id", "in_id"),
        "folded-neighbors",
    )
    links = materialize(neighbor_links(value_candidates, folded, combine), "neighbor-links")
    carried = folded.select(F.col("in_id").alias("entity_id"), F.col("entity_id").alias("feature"))
    posts = link_posts(
        carried.where(ids.is_first(F.col("entity_id"))),
        carried.where(ids.is_second(F.col("entity_id"))),
        links.select(F.col("d1_id").alias("f1"), F.col("d2_id").alias("f2"), "weight", "n1", "n2"),
    )
    best = top_partners(materialize(posts, "neighbor-posts"), k, combine=combine, effort=effort, probes=probes)
    # the K best entities are among the K smallest of the K best classes
    smallest = keep_top(classes, "class_id", [F.col("entity_id").asc()], k)
    theirs = smallest.select(F.col("class_id").alias("cand_class"), F.col("entity_id").alias("cand_id"))
    offered = best.select(F.col("entity_id").alias("class_id"), F.col("cand_id").alias("cand_class"), "score")
    lists = keep_top(offered.join(theirs, "cand_class"), "class_id", best_first(), k)
    return classes.join(lists.select("class_id", "cand_id", "score", "rank"), "class_id").select(
        "entity_id", "cand_id", "score", "rank"
    )


def _alike(in_neighbors: DataFrame) -> DataFrame:
    """``(entity_id, class_id)`` of the entities that have neighbours; a class is named by its smallest id.

    Entities of a collection that have the same neighbours have the same list.
    One with more than FOLDED neighbours is a class of its own, so that they stay spread.
    """
    carried = in_neighbors.where("in_id IS NOT NULL AND entity_id IS NOT NULL").select(
        F.col("in_id").alias("entity_id"), F.col("entity_id").alias("feature")
    )
    counts = materialize(carried.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "neighbor-counts")
    few, many = counts.where(F.col("n") <= FOLDED), counts.where(F.col("n") > FOLDED)
    sets = (
        carried.join(few.select("entity_id"), "entity_id", "left_semi")
        .groupBy("entity_id")
        .agg(F.sort_array(F.collect_list("feature")).alias("features"))
    )
    sets = materialize(sets.withColumn("first", ids.is_first(F.col("entity_id"))), "neighbor-sets")
    named = sets.groupBy("first", "features").agg(F.min("entity_id").alias("class_id"))
    same = sets.join(named, ["first", "features"]).select("entity_id", "class_id")
    return same.unionByName(many.select("entity_id", F.col("entity_id").alias("class_id")))
