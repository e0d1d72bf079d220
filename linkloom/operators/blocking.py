"""Blocking: which entities of the two collections are compared at all.

A block collection is a long table ``(block_id, entity_id)``.  Only counts are
grouped by block, so no block is ever gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import ids, scores, text

KEEP_RATIO = 0.8


def token_members(
    entities: DataFrame, entity_id: str = "entity_id", text_column: str = "text"
) -> DataFrame:
    """``(block_id, entity_id)``: every entity under every word it uses."""
    return entities.select(
        F.explode(text.tokens(F.col(text_column))).alias("block_id"),
        F.col(entity_id).cast("bigint").alias("entity_id"),
    )


def token_blocking(
    entities: DataFrame,
    entity_id: str = "entity_id",
    text_column: str = "text",
) -> DataFrame:
    """One block per word that occurs in both collections.

    Every two-sided block is kept.  A workflow that filters the blocks anyway can
    start from `token_members`: filtering drops one-sided blocks itself.
    """
    members = token_members(entities, entity_id, text_column)
    return members.join(block_sizes(members).select("block_id"), "block_id", "left_semi")


def block_sizes(members: DataFrame) -> DataFrame:
    """``(block_id, n1, n2)`` of the blocks that hold both collections."""
    entity = F.col("entity_id")
    return (
        members.groupBy("block_id")
        .agg(
            F.count_if(ids.is_first(entity)).alias("n1"),
            F.count_if(ids.is_second(entity)).alias("n2"),
        )
        .where((F.col("n1") > 0) & (F.col("n2") > 0))
    )


def with_sizes(members: DataFrame) -> DataFrame:
    """``(block_id, entity_id, n1, n2)``; one-sided blocks are gone."""
    # hashed by block: the memberships need no sort by word, and the sizes are one row per block
    return members.select("block_id", "entity_id").join(block_sizes(members).hint("shuffle_hash"), "block_id")


def block_utility(members: DataFrame) -> DataFrame:
    """``(entity_id, block_id, utility)``; a lower utility means a more telling block."""
    return with_sizes(members).select(
        "entity_id", "block_id", F.greatest("n1", "n2").alias("utility")
    )


def block_filtering(members: DataFrame, keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """Every entity keeps its ``round(keep_ratio * n)`` most telling blocks.

    Returns the entity index ``(entity_id, block_id, pos)``, ``pos`` from 1.
    """
    per_entity = Window.partitionBy("entity_id")
    best_first = per_entity.orderBy("utility", "block_id")
    return (
        block_utility(members)
        .withColumn("pos", F.row_number().over(best_first))
        .withColumn("n_blocks", F.count(F.lit(1)).over(per_entity))
        .where(F.col("pos") <= F.greatest(F.round(F.lit(keep_ratio) * F.col("n_blocks")), F.lit(1.0)))
        .select("entity_id", "block_id", "pos")
    )


def rebuild_blocks(entity_index: DataFrame) -> DataFrame:
    """Blocks of the filtered index that still hold both collections, with sizes."""
    return with_sizes(entity_index)


def blocks_per_entity(entity_index: DataFrame) -> DataFrame:
    return entity_index.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_blocks"))


def block_weights(sized: DataFrame, n1_total: Column, n2_total: Column) -> DataFrame:
    """ARCS weight and both inverse-frequency weights of every block."""
    sizes = sized.groupBy("block_id").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    return sizes.select(
        "block_id",
        "n1",
        "n2",
        scores.arcs_weight(n1, n2).alias("arcs"),
        scores.idf(n1_total, n1).alias("idf1"),
        scores.idf(n2_total, n2).alias("idf2"),
    )


def side_counts(entity_index: DataFrame) -> DataFrame:
    """One row ``(n1_total, n2_total)``: entities per collection in the index."""
    per_entity = entity_index.select("entity_id").distinct()
    entity = F.col("entity_id")
    return per_entity.agg(
        F.count_if(ids.is_first(entity)).alias("n1_total"),
        F.count_if(ids.is_second(entity)).alias("n2_total"),
    )


def blocking_stats(entity_index: DataFrame, sized: DataFrame) -> DataFrame:
    """One row: assignments, entities, clean blocks, comparisons, BCin and K."""
    index_row = blocks_per_entity(entity_index).agg(
        F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("assignments"),
        F.count(F.lit(1)).alias("entities"),
    )
    sizes = sized.groupBy("block_id").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    product = F.col("n1").cast("decimal(19,0)") * F.col("n2").cast("decimal(19,0)")
    clean_blocks = sizes.agg(F.count(F.lit(1)).alias("v")).scalar()
    total = sizes.agg(F.coalesce(F.sum(product), F.lit(0)).cast("decimal(38,0)").alias("v")).scalar()
    bcin = F.try_divide(F.col("assignments").cast("double"), F.col("entities").cast("double"))
    return (
        index_row.withColumn("clean_blocks", clean_blocks)
        .withColumn("comparisons", total)
        .withColumn("bcin", bcin)
        .withColumn("k", F.greatest(F.lit(1), F.floor("bcin")).cast("bigint"))
    )


def default_k(entity_index: DataFrame) -> int:
    """``max(1, floor(assignments / entities))``, read as one small row."""
    row = entity_index.agg(
        F.count(F.lit(1)).alias("assignments"),
        F.count_distinct("entity_id").alias("entities"),
    ).first()
    return max(1, row["assignments"] // row["entities"]) if row["entities"] else 1


def candidate_counts(sized: DataFrame) -> DataFrame:
    """The expansion of every block in factored form.

    For each entity and block: how many entities of its own collection the
    block holds and how many candidates of the other one it offers.  Joined
    with the block table this is the whole expansion, but it grows with the
    assignments instead of with the comparisons.
    """
    first = ids.is_first(F.col("entity_id"))
    return sized.select(
        "entity_id",
        "block_id",
        F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("n_same"),
        F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("n_candidates"),
    )


def candidate_pairs(sized: DataFrame) -> DataFrame:
    """Every cross-collection pair of every block: ``(block_id, d2_id, d1_id, n1, n2)``.

    The result has ``n1 * n2`` rows per block by definition.  The top-K
    operators do not use it; it serves inspection of small block collections.
    """
    second = sized.where(ids.is_second(F.col("entity_id")))
    first = sized.where(ids.is_first(F.col("entity_id")))
    return second.select("block_id", F.col("entity_id").alias("d2_id"), "n1", "n2").join(
        first.select("block_id", F.col("entity_id").alias("d1_id")), "block_id"
    )
