"""Matching: from candidate lists to one partner per collection-2 entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import ids, scores

VALUE_FACTOR = 0.6
SURE_SCORE = 1.0


def top1_value_matches(value_candidates: DataFrame, threshold: float = SURE_SCORE) -> DataFrame:
    """Collection-2 entities whose best value candidate scores at least ``threshold``."""
    sure = (F.col("rank") == 1) & (F.col("score") >= threshold) & ids.is_second(F.col("entity_id"))
    return value_candidates.where(sure).select(
        F.col("entity_id").alias("d2_id"), F.col("cand_id").alias("d1_id")
    )


def _list_sizes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("entity_id").agg(F.max("rank").alias("size"))


def _ranked_share(candidates: DataFrame, factor: float) -> DataFrame:
    # at most 1, so that 64 bits hold the sums
    share = scores.to_fixed(scores.rank_score(factor, F.col("size"), F.col("rank"))).cast("bigint")
    return candidates.join(_list_sizes(candidates), "entity_id").select(
        "entity_id", "cand_id", share.alias("weight")
    )


def rank_scores(
    value_candidates: DataFrame,
    neighbor_candidates: DataFrame,
    matched: DataFrame,
    value_factor: float = VALUE_FACTOR,
) -> DataFrame:
    """Weighted sum of the value rank and the neighbour rank of every candidate.

    Value lists of collection-2 entities in ``matched`` are left out.  The
    result is ``(entity_id, cand_id, weight)`` with the weight in fixed point.
    """
    done = matched.select(F.col("d2_id").alias("entity_id"))
    values = _ranked_share(value_candidates.join(done, "entity_id", "left_anti"), value_factor)
    neighbors = _ranked_share(neighbor_candidates, 1 - value_factor)
    return (
        values.unionByName(neighbors)
        .groupBy("entity_id", "cand_id")
        .agg(F.sum("weight").alias("weight"))
    )


def candidate_edges(ranked: DataFrame) -> DataFrame:
    """``(d2_id, d1_id, side, weight)``; ``side`` tells whose list the edge is from."""
    return ranked.select(
        F.least("entity_id", "cand_id").alias("d2_id"),
        F.greatest("entity_id", "cand_id").alias("d1_id"),
        F.when(ids.is_first(F.col("entity_id")), F.lit(1)).otherwise(F.lit(2)).alias("side"),
        "weight",
    )


def joined_edges(edges: DataFrame) -> DataFrame:
    """One row per pair: ``(d2_id, d1_id, weight, reciprocal)``."""
    return edges.groupBy("d2_id", "d1_id").agg(
        F.sum("weight").alias("weight"), (F.min("side") != F.max("side")).alias("reciprocal")
    )


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """Pairs that both entities suggest."""
    return joined_edges(edges).where("reciprocal").select("d2_id", "d1_id", "weight")


def best_candidate(joined: DataFrame, matched: DataFrame) -> DataFrame:
    """The best pair of every collection-2 entity that ``matched`` does not settle."""
    standing = F.struct("weight", (-F.col("d1_id")).alias("low_id_first"), "d1_id", "reciprocal")
    return (
        joined.join(matched.select("d2_id"), "d2_id", "left_anti")
        .groupBy("d2_id")
        .agg(F.max(standing).alias("best"))
        .select("d2_id", "best.d1_id", "best.weight", "best.reciprocal")
    )


def reciprocal_matches(
    value_candidates: DataFrame,
    neighbor_candidates: DataFrame,
    value_factor: float = VALUE_FACTOR,
    threshold: float = SURE_SCORE,
) -> DataFrame:
    """``(d2_id, d1_id)``: sure value matches, and best candidates that are reciprocal."""
    sure = top1_value_matches(value_candidates, threshold)
    ranked = rank_scores(value_candidates, neighbor_candidates, sure, value_factor)
    best = best_candidate(joined_edges(candidate_edges(ranked)), sure)
    return best.where("reciprocal").select("d2_id", "d1_id").unionByName(sure)


def mutual_top1(top1: DataFrame) -> DataFrame:
    """Pairs ``(d2_id, d1_id)`` that are each other's top candidate in ``(entity_id, cand_id)``."""
    return (
        top1.groupBy(
            F.least("entity_id", "cand_id").alias("d2_id"),
            F.greatest("entity_id", "cand_id").alias("d1_id"),
        )
        .agg(F.count(F.lit(1)).alias("votes"))
        .where("votes = 2")
        .select("d2_id", "d1_id")
    )


def override(matches: DataFrame, certain: DataFrame) -> DataFrame:
    """``matches`` with the entities of ``certain`` replaced by the certain pairs."""
    return matches.join(certain.select("d2_id"), "d2_id", "left_anti").unionByName(certain)
