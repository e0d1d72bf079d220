"""Label matching: entities that alone share a name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text


def label_blocks(
    triples: DataFrame, entities: DataFrame, attributes: Iterable[str], drop_empty: bool = False
) -> DataFrame:
    """Distinct ``(label, entity_id)`` of the subjects that carry a label attribute."""
    names = [a.lower() for a in attributes]
    subjects = entities.select(F.col("uri").alias("s"), "entity_id")
    labels = (
        triples.where(F.col("p").isin(names))
        .select("s", text.normalize_label(F.col("o")).alias("label"))
        .join(subjects, "s")
        .select("label", "entity_id")
    )
    if drop_empty:
        labels = labels.where(F.col("label") != "")
    return labels.distinct()


def _sole_owner(labels: DataFrame, name: str) -> DataFrame:
    return (
        labels.groupBy("label")
        .agg(F.count(F.lit(1)).alias("owners"), F.min("entity_id").alias(name))
        .where("owners = 1")
        .select("label", name)
    )


def label_matches(labels1: DataFrame, labels2: DataFrame) -> DataFrame:
    """``(d2_id, d1_id)`` of labels with one owner in either collection.

    Both sides are reduced to unique labels before the join, so a label that
    very many entities carry never meets itself.  A collection-2 entity that
    its labels lead to several partners is left out.
    """
    return (
        _sole_owner(labels2, "d2_id")
        .join(_sole_owner(labels1, "d1_id"), "label")
        .groupBy("d2_id")
        .agg(F.min("d1_id").alias("d1_id"), F.max("d1_id").alias("last"))
        .where("d1_id = last")
        .select("d2_id", "d1_id")
    )
