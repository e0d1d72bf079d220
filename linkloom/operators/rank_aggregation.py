"""Borda aggregation of an entity's value list and neighbour list.

Both lists hold at most K candidates per entity, so all steps of one entity
work on a bounded group.  The lists are brought together with one shuffle on
the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of the sources of a match.
VALUES = "VALUES"
NEIGHBORS = "NEIGHBORS"
BOTH = "BOTH"
VALUES_ONLY_LIST = "VALUES_WITH_EMPTY_NEIGHBORS"
NEIGHBORS_ONLY_LIST = "NEIGHBORS_WITH_EMPTY_VALUES"
SOURCES = (VALUES, NEIGHBORS, BOTH, VALUES_ONLY_LIST, NEIGHBORS_ONLY_LIST)


def _merged(value_candidates: DataFrame, neighbor_candidates: DataFrame) -> DataFrame:
    """``(entity_id, cand_id, v_rank, n_rank, v_size, n_size)``; 0 sizes for missing lists."""
    missing = F.lit(None).cast("int")
    values = value_candidates.select("entity_id", "cand_id", F.col("rank").alias("v_rank"), missing.alias("n_rank"))
    neighbors = neighbor_candidates.select(
        "entity_id", "cand_id", missing.alias("v_rank"), F.col("rank").alias("n_rank")
    )
    entity = Window.partitionBy("entity_id")
    return (
        values.unionByName(neighbors)
        .repartition("entity_id")
        .groupBy("entity_id", "cand_id")
        .agg(F.max("v_rank").alias("v_rank"), F.max("n_rank").alias("n_rank"))
        .withColumn("v_size", F.coalesce(F.max("v_rank").over(entity), F.lit(0)))
        .withColumn("n_size", F.coalesce(F.max("n_rank").over(entity), F.lit(0)))
    )


def _points(rank: str, top: Column) -> Column:
    return top - F.col(rank) + 1


def borda_top1(value_candidates: DataFrame, neighbor_candidates: DataFrame) -> DataFrame:
    """``(entity_id, cand_id, score)``: the candidate with the most Borda points.

    Each list gives ``longest`` points to its first candidate and one less to
    each following one.  The head of the value list wins a tie at ``longest``
    points; other ties go to the earlier place in the longer list.
    """
    longest = F.greatest("v_size", "n_size")
    score = F.coalesce(_points("v_rank", longest), F.lit(0)) + F.coalesce(_points("n_rank", longest), F.lit(0))
    head = (F.col("v_rank") == 1) & (F.col("score") == longest)
    place = F.when(F.col("v_size") >= F.col("n_size"), F.col("v_rank")).otherwise(F.col("n_rank"))
    order = Window.partitionBy("entity_id").orderBy(
        F.col("score").desc(),
        F.coalesce(head, F.lit(False)).desc(),
        place.asc_nulls_last(),
        F.col("cand_id").asc(),
    )
    return (
        _merged(value_candidates, neighbor_candidates)
        .withColumn("score", score)
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select("entity_id", "cand_id", "score")
    )


def borda_provenance(value_candidates: DataFrame, neighbor_candidates: DataFrame, k: int) -> DataFrame:
    """``(entity_id, cand_id, score, rank, source, has_common)``: the K best by Borda points.

    A candidate of both lists gets its value points plus the size of the value
    list minus its place in the neighbour list, which may be negative.  An
    entity with one list keeps the order of that list and the points K, K-1...
    """
    longest = F.greatest("v_size", "n_size")
    in_values, in_neighbors = F.col("v_rank").isNotNull(), F.col("n_rank").isNotNull()
    source = (
        F.when(F.col("n_size") == 0, VALUES_ONLY_LIST)
        .when(F.col("v_size") == 0, NEIGHBORS_ONLY_LIST)
        .when(in_values & in_neighbors, BOTH)
        .when(in_values, VALUES)
        .otherwise(NEIGHBORS)
    )
    score = (
        F.when(F.col("source") == VALUES_ONLY_LIST, _points("v_rank", F.lit(k)))
        .when(F.col("source") == NEIGHBORS_ONLY_LIST, _points("n_rank", F.lit(k)))
        .when(F.col("source") == BOTH, _points("v_rank", longest) + _points("n_rank", F.col("v_size")))
        .when(F.col("source") == VALUES, _points("v_rank", longest))
        .otherwise(_points("n_rank", longest))
    )
    entity = Window.partitionBy("entity_id")
    order = entity.orderBy(F.col("score").desc(), F.col("cand_id").asc())
    return (
        _merged(value_candidates, neighbor_candidates)
        .withColumn("source", source)
        .withColumn("score", score)
        .withColumn("has_common", F.bool_or(in_values & in_neighbors).over(entity))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("entity_id", "cand_id", "score", "rank", "source", "has_common")
    )


def borda_topk(value_candidates: DataFrame, neighbor_candidates: DataFrame, k: int) -> DataFrame:
    """``(entity_id, cand_id, score, rank)``: as `borda_provenance`, without the sources."""
    return borda_provenance(value_candidates, neighbor_candidates, k).drop("source", "has_common")


def provenance_counts(aggregated: DataFrame) -> DataFrame:
    """Kept results per source: ``(source, results)``."""
    return aggregated.groupBy("source").agg(F.count(F.lit(1)).alias("results"))


def lists_with_common(aggregated: DataFrame) -> DataFrame:
    """One row: how many entities have lists, and how many of them share a candidate."""
    per_entity = aggregated.groupBy("entity_id").agg(F.bool_or("has_common").alias("common"))
    return per_entity.agg(F.count(F.lit(1)).alias("lists"), F.count_if("common").alias("with_common"))
