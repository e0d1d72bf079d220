"""Meta-blocking: weigh co-occurring pairs and keep the top K of every entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import ids, scores
from linkloom.operators.blocking import side_counts
from linkloom.operators.shared_top_k import EFFORT, PROBES, top_partners
from linkloom.runtime import materialize

SCHEMES = ("cbs", "arcs", "idf", "wjs")


def _totals(entity_index: DataFrame) -> tuple[Column, Column]:
    counts = side_counts(entity_index)
    return counts.select("n1_total").scalar(), counts.select("n2_total").scalar()


def _fixed_weight(scheme: str, sized: DataFrame, entity_index: DataFrame | None) -> DataFrame:
    """``sized`` plus the fixed-point weight of the block."""
    n1, n2 = F.col("n1"), F.col("n2")
    if scheme == "cbs":
        return sized.withColumn("weight", F.lit(scores.UNIT).cast("decimal(38,0)"))
    if scheme == "arcs":
        return sized.withColumn("weight", scores.to_fixed(scores.arcs_weight(n1, n2)))
    n1_total, n2_total = _totals(sized if entity_index is None else entity_index)
    both = scores.to_fixed(scores.idf(n1_total, n1)) + scores.to_fixed(scores.idf(n2_total, n2))
    return sized.withColumn("weight", both)


def entity_weights(sized: DataFrame, entity_index: DataFrame) -> DataFrame:
    """Summed inverse frequency of an entity's surviving blocks: ``(entity_id, norm)``.

    ``norm`` is in fixed point.  An entity all of whose blocks were lost has 0.
    """
    n1_total, n2_total = _totals(entity_index)
    own = F.when(
        ids.is_first(F.col("entity_id")), scores.to_fixed(scores.idf(n1_total, F.col("n1")))
    ).otherwise(scores.to_fixed(scores.idf(n2_total, F.col("n2"))))
    summed = sized.groupBy("entity_id").agg(F.sum(own).alias("norm"))
    return (
        entity_index.select("entity_id")
        .distinct()
        .join(summed, "entity_id", "left")
        .select("entity_id", F.coalesce("norm", F.lit(0)).cast("decimal(38,0)").alias("norm"))
    )


def top_candidates(
    sized: DataFrame,
    k: int,
    scheme: str = "arcs",
    *,
    entity_index: DataFrame | None = None,
    effort: int = EFFORT,
    probes: int = PROBES,
) -> DataFrame:
    """Top-K candidates of every entity of both collections.

    sized -- rebuilt blocks ``(block_id, entity_id, n1, n2)``
    scheme -- ``cbs`` common blocks, ``arcs`` summed block rarity, ``idf``
        summed inverse frequencies, ``wjs`` the latter over the entity weights
    entity_index -- the filtered index; it defines the collection sizes that
        ``idf`` and ``wjs`` use (default: the entities in ``sized``)
    effort, probes -- as in `top_partners`
    """
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    weighted = _fixed_weight(scheme, sized, entity_index)
    norms = None
    if scheme == "wjs":
        norms = materialize(entity_weights(sized, sized if entity_index is None else entity_index), "norms")
    posts = weighted.select("entity_id", F.col("block_id").alias("link"), "weight", "n1", "n2")
    return top_partners(posts, k, norms=norms, effort=effort, probes=probes)
