"""What several text operators need: reading, row ids, numbering without one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.runtime import materialize

#: The white space that separates words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_modulo(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo; a null counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def ordered(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Write ``df`` in the order of ``keys`` with ``_part`` and ``_at``.

    Range partitions hold consecutive rows; ``_at`` numbers the rows of one
    partition from 0.  The written table is read back, so a lost executor
    cannot change a number that was already used.  Rows that tie on all keys
    are numbered in any order.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return materialize(placed, name)


def row_numbers(placed: DataFrame, name: str = "row_number") -> DataFrame:
    """Global row number from 0 for the result of ``ordered``.

    Only one count per range partition meets in one task.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_before", "_part", "_at")
    )


def running_totals(placed: DataFrame, group: str, value: str, name: str = "before") -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same group, for ``ordered`` rows.

    A hot group spreads over many range partitions: sums run inside each
    partition, and one total per (group, partition) carries them on.
    """
    inside = (
        Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        placed.groupBy(F.col("_part").alias("_q"), F.col(group).alias("_g"))
        .agg(F.sum(value).alias("_n"))
        .select(
            "_q",
            "_g",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_carried"),
        )
    )
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(
        totals, (F.col("_part") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g"))
    )
    return joined.withColumn(name, F.col("_inside") + F.col("_carried")).drop(
        "_inside", "_carried", "_part", "_at", "_q", "_g"
    )


def mark(text: str | Column) -> Column:
    """A 128-bit mark of the unchanged text, for telling rows of one id apart."""
    column = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(column, F.lit("")).cast("binary"))


def keep_decided(docs: DataFrame, decisions: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, mark, kept; one row each) keep.

    Rows are matched by id and mark of the text, so ids may be null or repeated;
    of rows that agree in both, as many stay as decisions keep.
    The texts move once; the decisions are small rows.  The columns of ``docs``
    travel in one struct, so that they may have any names.
    """
    by_row = materialize(
        decisions.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"))
        .agg(F.count_if("kept").alias("stay"), F.count("*").alias("n"))
        .filter("stay < n"),
        "decisions",
    )
    given = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), mark(text).alias("mark"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    left = given.join(by_row.filter("stay = 0"), same, "left_anti").select("row", "id", "mark")
    again = by_row.filter("stay > 0")
    if not again.isEmpty():
        first = Window.partitionBy("id", "mark").orderBy(F.lit(0))
        some = left.join(again, same).withColumn("nth", F.row_number().over(first)).filter("nth <= stay")
        left = left.join(again, same, "left_anti").unionByName(some.select("row", "id", "mark"))
    return left.select("row.*")


def free_name(taken: Sequence[str], wish: str) -> str:
    """``wish``, or it with underscores where a column has that name."""
    known = {name.lower() for name in taken}
    while wish.lower() in known:
        wish += "_"
    return wish
