"""Precision, recall and F1 of matches and candidate lists against a ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import ids, scores
from linkloom.operators import tiles
from linkloom.operators.blocking import with_sizes
from linkloom.operators.rank_aggregation import SOURCES
from linkloom.operators.shared_top_k import DENSE, FEW, in_cells
from linkloom.runtime import materialize


def with_quality(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to ``(tp, fp, fn)``; undefined ones are null."""
    tp = F.col("tp").cast("double")
    precision = F.try_divide(tp, (F.col("tp") + F.col("fp")).cast("double"))
    recall = F.try_divide(tp, (F.col("tp") + F.col("fn")).cast("double"))
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", scores.harmonic_mean(F.col("precision"), F.col("recall")))
    )


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def evaluate_matches(matches: DataFrame, truth: DataFrame, truth_only: bool = False) -> DataFrame:
    """One row ``tp, fp, fn, precision, recall, f1`` for ``(d2_id, d1_id)`` matches.

    truth_only -- ignore matches of entities the ground truth does not name
    """
    mine = matches.select("d2_id", F.col("d1_id").alias("found"))
    known = truth.select("d2_id", F.col("d1_id").alias("correct"))
    joined = mine.join(known, "d2_id", "right" if truth_only else "full_outer")
    found, correct = F.col("found"), F.col("correct")
    counts = joined.agg(
        _count(found == correct).alias("tp"),
        _count(found.isNotNull() & (correct.isNull() | (found != correct))).alias("fp"),
        _count(correct.isNotNull() & (found.isNull() | (found != correct))).alias("fn"),
    )
    return with_quality(counts)


def _judged_entities(candidates: DataFrame, truth: DataFrame, *carried: str) -> DataFrame:
    """``(d2_id, listed, hit, known)``: the length of each list, and whether it has the match.

    Lists and truth are counted together, pair by pair and then by entity, so
    that no list meets the truth as a whole: one of very many candidates is
    added up where it lies.  Columns in ``carried`` give the values of the hit.
    """
    mine = candidates.select("d2_id", "d1_id", *carried, F.lit(1).alias("listed"), F.lit(0).alias("known"))
    nothing = [F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in carried]
    right = truth.select("d2_id", "d1_id", *nothing, F.lit(0).alias("listed"), F.lit(1).alias("known"))
    pairs = (
        mine.unionByName(right)
        .groupBy("d2_id", "d1_id")
        .agg(F.max("listed").alias("listed"), F.max("known").alias("known"), *[F.max(c).alias(c) for c in carried])
    )
    hit = (F.col("listed") == 1) & (F.col("known") == 1)
    return pairs.groupBy("d2_id").agg(
        F.sum("listed").alias("listed"),
        F.count_if(hit).alias("hit"),
        F.sum("known").alias("known"),
        *[F.max(F.when(hit, F.col(c))).alias(c) for c in carried],
    )


def _totals() -> list[Column]:
    return [
        F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.col("listed") - F.col("hit")), F.lit(0)).alias("fp"),
        _count((F.col("known") > 0) & (F.col("hit") == 0)).alias("fn"),
    ]


def evaluate_candidates(candidates: DataFrame, truth: DataFrame, truth_only: bool = False) -> DataFrame:
    """One quality row for candidate pairs ``(d2_id, d1_id)``; a repeated pair counts once.

    A hit is one true positive and makes the rest of the list false positives.
    """
    judged = _judged_entities(candidates, truth)
    if truth_only:
        judged = judged.where("known > 0")
    return with_quality(judged.agg(*_totals()))


def missed_matches(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Ground-truth pairs that were not found: ``(d2_id, correct, n_candidates)``."""
    sizes = candidates.groupBy("d2_id").agg(F.count("d1_id").alias("n_candidates"))
    return (
        truth.select("d2_id", "d1_id")
        .join(candidates, ["d2_id", "d1_id"], "left_anti")
        .join(sizes, "d2_id", "left")
        .select("d2_id", F.col("d1_id").alias("correct"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
    )


def true_positives_by_source(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """``(source, tp)`` for candidates ``(d2_id, d1_id, source)``."""
    hits = candidates.join(truth, ["d2_id", "d1_id"], "left_semi")
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("tp"))


def evaluate_by_source(candidates: DataFrame, truth: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """``(source, source_tp, tp, fp, fn, precision, recall, f1)`` for ``(d2_id, d1_id, source)``.

    One row for each of ``sources``, also for those without a hit: the matches
    found through it, beside the totals of all lists.  Both come from one pass
    over the lists; the totals are sums over one row per source.
    """
    by_source = materialize(
        _judged_entities(candidates, truth, "source").groupBy("source").agg(*_totals()), "quality-by-source"
    )
    summed = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    found = by_source.select("source", F.col("tp").alias("source_tp"))
    names = by_source.agg(*summed).select(F.explode(F.array(*map(F.lit, sources))).alias("source"), "tp", "fp", "fn")
    source_tp = F.coalesce("source_tp", F.lit(0)).alias("source_tp")
    return with_quality(names.join(found, "source", "left").select("source", source_tp, "tp", "fp", "fn"))


def true_positive_ids(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct ``d2_id`` whose candidates include the match."""
    return candidates.join(truth, ["d2_id", "d1_id"], "left_semi").select("d2_id").distinct()


def second_lists(candidates: DataFrame) -> DataFrame:
    """``(d2_id, d1_id)`` from the lists of collection-2 entities."""
    return candidates.where(ids.is_second(F.col("entity_id"))).select(
        F.col("entity_id").alias("d2_id"), F.col("cand_id").alias("d1_id")
    )


def reversed_first_lists(candidates: DataFrame) -> DataFrame:
    """``(d2_id, d1_id)`` from the lists of collection-1 entities."""
    return candidates.where(ids.is_first(F.col("entity_id"))).select(
        F.col("cand_id").alias("d2_id"), F.col("entity_id").alias("d1_id")
    )


def symmetric_candidates(candidates: DataFrame) -> DataFrame:
    """Distinct pairs that either entity lists."""
    # in one pass: lists that are not written out would be made once for each side
    second = ids.is_second(F.col("entity_id"))
    pairs = candidates.where("entity_id IS NOT NULL").select(
        F.when(second, F.col("entity_id")).otherwise(F.col("cand_id")).alias("d2_id"),
        F.when(second, F.col("cand_id")).otherwise(F.col("entity_id")).alias("d1_id"),
    )
    return pairs.distinct()


def evaluate_sides(top1: DataFrame, truth: DataFrame) -> DataFrame:
    """Quality of top-1 candidates of each collection apart: ``(side, tp, ...)``."""
    second = evaluate_matches(second_lists(top1), truth).withColumn("side", F.lit(2))
    first = evaluate_candidates(reversed_first_lists(top1), truth).withColumn("side", F.lit(1))
    return second.unionByName(first)


def contributions(value_pairs: DataFrame, neighbor_pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: matches found by values, by neighbours, by either and by both."""
    by_value = true_positive_ids(value_pairs, truth).withColumn("by_value", F.lit(True))
    by_neighbor = true_positive_ids(neighbor_pairs, truth).withColumn("by_neighbor", F.lit(True))
    joined = by_value.join(by_neighbor, "d2_id", "full_outer")
    known = truth.agg(F.count(F.lit(1)).alias("v")).scalar()
    return joined.agg(
        F.count("by_value").alias("from_values"),
        F.count("by_neighbor").alias("from_neighbors"),
        F.count(F.lit(1)).alias("either"),
        F.count_if(F.col("by_value") & F.col("by_neighbor")).alias("both"),
    ).withColumn("max_recall", F.try_divide(F.col("either").cast("double"), known.cast("double")))


def _met_pairs(sized: DataFrame) -> DataFrame:
    """One row ``v``: how many distinct pairs meet in some block.

    A pair is counted in its largest common block alone: there no larger block
    of one entity is a larger block of the other.  So each membership carries
    the larger blocks of its entity, and members that agree in them are folded
    into one row with their number.  The largest blocks have the fewest larger
    ones, so that those with the most pairs fold best.  What is shuffled grows
    with the memberships; pairs are neither listed nor made distinct.
    """
    blocks = materialize(
        sized.select("block_id", "n1", "n2").distinct().withColumn("number", F.monotonically_increasing_id()), "blocks"
    )
    larger = (
        Window.partitionBy("entity_id")
        .orderBy(scores.comparisons(F.col("n1"), F.col("n2")).desc(), "number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = ids.is_first(F.col("entity_id"))
    folded = (
        sized.select("block_id", "entity_id")
        .join(blocks, "block_id")
        .withColumn("above", F.collect_list("number").over(larger))
        .groupBy("number", first.alias("first"), "above")
        .agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("c"))
    )
    folded = materialize(folded, "folded-members")
    rows = folded.groupBy("number").agg(
        F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2")
    )
    placed = folded.join(rows, "number")
    one, two = in_cells(placed.where("first"), placed.where("NOT first"), "above", "above")
    key = ["number", "row", "col"]
    met = one.select(*key, F.col("above").alias("e1"), F.col("c").alias("c1")).join(
        two.select(*key, F.col("above").alias("e2"), F.col("c").alias("c2")), key
    )
    pairs = F.when(~F.arrays_overlap("e1", "e2"), F.col("c1") * F.col("c2"))
    return met.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("bigint").alias("v"))


def evaluate_blocks(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Quality of all distinct pairs that share a block, without filtering."""
    sized = materialize(with_sizes(members), "sized-blocks")
    other = F.when(ids.is_first(F.col("entity_id")), F.col("n2")).otherwise(F.col("n1")).cast("double")
    entities = sized.groupBy("entity_id").agg(F.sum(other).alias("offered"), F.count(F.lit(1)).alias("links"))
    row = entities.agg(
        F.sum("offered").alias("offered"),
        F.max("links").alias("links"),
        F.count_if(ids.is_first(F.col("entity_id"))).alias("n1"),
        F.count_if(ids.is_second(F.col("entity_id"))).alias("n2"),
    ).first()
    if (row["links"] or 0) > FEW and row["offered"] * DENSE >= 2.0 * row["n1"] * row["n2"]:
        size = scores.comparisons(F.col("n1"), F.col("n2")).alias("weight")
        posts = sized.select("entity_id", F.col("block_id").alias("link"), size)
        total = materialize(tiles.count_met(posts, row["n1"], row["n2"]), "met-pairs").scalar()
    else:
        total = _met_pairs(sized).scalar()
    known = truth.agg(F.count(F.lit(1)).alias("v")).scalar()
    kept = sized.select("block_id", "entity_id")
    found = (
        truth.join(kept.withColumnRenamed("entity_id", "d2_id"), "d2_id")
        .join(kept.withColumnRenamed("entity_id", "d1_id"), ["block_id", "d1_id"], "left_semi")
        .select("d2_id", "d1_id")
        .distinct()
    )
    counts = found.agg(F.count(F.lit(1)).alias("tp"))
    return with_quality(
        counts.withColumn("fp", total - F.col("tp")).withColumn("fn", known - F.col("tp")).select("tp", "fp", "fn")
    )
