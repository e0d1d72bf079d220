"""Relations between entities: their importance and each entity's best neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import ids, scores
from linkloom.runtime import materialize

MIN_SUPPORT = 0.01


def resolve_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """``(p, s_id, o, o_id)``: subject ids, and object ids where the object is an entity.

    Objects are looked up by hash: very many triples may have the same object, and
    a task need not sort them.
    """
    subjects = entities.select(F.col("uri").alias("s"), F.col("entity_id").alias("s_id"))
    objects = entities.select(F.col("uri").alias("o"), F.col("entity_id").alias("o_id")).hint("shuffle_hash")
    return triples.join(subjects, "s").join(objects, "o", "left").select("p", "s_id", "o", "o_id")


def relation_index(resolved: DataFrame) -> DataFrame:
    """``(p, s_id, o_id)`` of the predicates whose objects are mostly entities.

    The predicates are written: Spark sees how few they are and does not move the
    triples to one task for each predicate.
    """
    votes = resolved.groupBy("p").agg(
        F.count("o_id").alias("entity_objects"), F.count(F.lit(1)).alias("all_objects")
    )
    relations = materialize(
        votes.where(F.col("entity_objects") > F.col("all_objects") - F.col("entity_objects")).select("p"), "relations"
    )
    return (
        resolved.where("o_id is not null")
        .join(relations, "p", "left_semi")
        .select("p", "s_id", "o_id")
    )


def _importance(counted: DataFrame) -> DataFrame:
    """Add support, discriminability and score to ``(p, n, n_objects)``."""
    largest = counted.agg(F.max("n").alias("v")).scalar()
    return (
        counted.withColumn("support", F.col("n").cast("double") / largest.cast("double"))
        .withColumn("discriminability", F.col("n_objects").cast("double") / F.col("n").cast("double"))
        .withColumn("score", scores.harmonic_mean(F.col("support"), F.col("discriminability")))
        .select("p", "support", "discriminability", "score")
    )


def relation_stats(index: DataFrame) -> DataFrame:
    """``(p, support, discriminability, score)``.

    Support is the share of the most frequent relation's pairs,
    discriminability the share of distinct objects, score their harmonic mean.
    """
    return _importance(
        index.groupBy("p").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("o_id").alias("n_objects")
        )
    )


def predicate_stats(resolved: DataFrame) -> DataFrame:
    """`relation_stats` of `relation_index`, straight from the resolved triples.

    The majority vote and the counts share one aggregation, so a workflow need
    not build the index: its relations are those of this table.
    """
    return _importance(
        resolved.groupBy("p")
        .agg(
            F.count("o_id").alias("n"),
            F.count(F.lit(1)).alias("all_objects"),
            F.count_distinct("o_id").alias("n_objects"),
        )
        .where(F.col("n") > F.col("all_objects") - F.col("n"))
    )


def relation_rank(stats: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Relations above the support threshold, best first.

    The rank is numbered over one row per predicate, not over the data.
    """
    best_first = Window.orderBy(F.col("score").desc(), F.col("p").asc())
    return stats.where(F.col("support") > min_support).withColumn("rank", F.row_number().over(best_first))


def top_out_neighbors(
    index: DataFrame,
    stats: DataFrame,
    n: int = 3,
    min_support: float = MIN_SUPPORT,
    keep_low_support: bool = False,
) -> DataFrame:
    """``(entity_id, out_id)``: objects of the ``n`` best relations of every subject.

    An object reached by several relations counts for the best of them.
    ``keep_low_support`` ranks relations under the threshold first instead of
    leaving them out.  Only the distinct relations of a subject are ranked, at
    most one row per predicate; its objects, however many, stay spread and are
    checked against them.
    """
    enough = F.col("support") > min_support
    if keep_low_support:
        order = stats.select(
            "p",
            F.when(enough, F.struct((-F.col("score")).alias("key"), F.col("p").alias("name")))
            .otherwise(F.struct(F.lit(float("-inf")).alias("key"), F.lit("").alias("name")))
            .alias("standing"),
        )
    else:
        order = stats.where(enough).select(
            "p", F.struct((-F.col("score")).alias("key"), F.col("p").alias("name")).alias("standing")
        )
    order = materialize(order, "relation-standings")  # few rows, and Spark sees it
    best = index.join(order, "p").groupBy("s_id", "o_id").agg(F.min("standing").alias("standing"))
    relations = best.groupBy("s_id", "standing").agg(F.count(F.lit(1)).alias("n_objects"))
    by_standing = Window.partitionBy("s_id").orderBy("standing")
    kept = relations.withColumn("place", F.row_number().over(by_standing)).where(F.col("place") <= n)
    return best.join(kept.select("s_id", "standing"), ["s_id", "standing"], "left_semi").select(
        F.col("s_id").alias("entity_id"), F.col("o_id").alias("out_id")
    )


def in_neighbors(out_neighbors: DataFrame) -> DataFrame:
    """``(entity_id, in_id)``: who has the entity among its top out-neighbours."""
    return out_neighbors.select(
        F.col("out_id").alias("entity_id"), F.col("entity_id").alias("in_id")
    ).distinct()


def label_attributes(resolved: DataFrame, top: int = 3) -> DataFrame:
    """The predicates that best serve as names: ``(p, support, discriminability, score, rank)``.

    They are the predicates with mostly literal objects, ranked like relations.
    """
    counted = (
        resolved.groupBy("p")
        .agg(
            F.count("o_id").alias("entity_objects"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("o").alias("n_objects"),
        )
        .where(F.col("entity_objects") <= F.col("n") - F.col("entity_objects"))
        .select("p", "n", "n_objects")
    )
    best_first = Window.orderBy(F.col("score").desc(), F.col("p").asc())
    ranked = _importance(counted).withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= top)


def merge_in_neighbors(first: DataFrame, second: DataFrame) -> DataFrame:
    """In-neighbours of both collections in one table; signed ids keep them apart."""
    return first.unionByName(second)


def signed(entities: DataFrame, collection: int) -> DataFrame:
    """``(uri, entity_id)`` with the ids of collection 2 encoded as negatives."""
    if collection == 1:
        return entities.select("uri", "entity_id")
    return entities.select("uri", ids.encode_second(F.col("entity_id")).alias("entity_id"))
