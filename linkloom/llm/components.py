"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (a, b): the smallest node of its component.

    Labels spread over the links and then jump to the label of their label, so
    stars take two rounds and a chain a logarithmic number.  Each round is a
    written table; a node with very many links meets its neighbours in a
    partial minimum, never in one list.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels"
    )
    while True:
        of_target = labels.select(F.col("node").alias("b"), F.col("label").alias("far"))
        near = both.join(of_target, "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        spread = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "far").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(
            spread.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels"
        )
        changed = not after.filter("label != old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels
