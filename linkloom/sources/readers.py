"""Readers.  Each parser takes a DataFrame with one string column ``value``,
so the same code serves files, streams of lines and derived tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import ids, text

VALUE = "value"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def triple_separator(path: str) -> str:
    return "\t" if path.endswith(".tsv") else " "


def parse_blocks(lines: DataFrame) -> DataFrame:
    """``(block_id, entity_id)`` from ``blockId TAB id#id#...;id#id#...``.

    Lines that do not have exactly two fields are dropped.
    """
    fields = F.split(F.rtrim(F.col(VALUE), F.lit("\t")), "\t")
    return (
        lines.select(fields.alias("f"))
        .where((F.size("f") == 2) & (F.col("f")[1] != ""))
        .select(
            F.col("f")[0].cast("bigint").alias("block_id"),
            F.explode(F.split(F.col("f")[1], "[;#]")).alias("id"),
        )
        .where("id != ''")
        .select("block_id", F.col("id").cast("bigint").alias("entity_id"))
    )


def parse_entity_ids(lines: DataFrame, collection: int = 1) -> DataFrame:
    """``(uri, entity_id)`` from ``uri TAB id``; ids of collection 2 become negative.

    URIs are read in lower case and have one id each: of several, the largest.
    """
    fields = F.split(F.lower(F.col(VALUE)), "\t")
    numbered = lines.select(fields[0].alias("uri"), fields[1].cast("bigint").alias("number"))
    number = F.col("number")
    entity_id = number if collection == 1 else ids.encode_second(number)
    return numbered.groupBy("uri").agg(F.max("number").alias("number")).select("uri", entity_id.alias("entity_id"))


def _statement(separator: str) -> Column:
    """The lower-cased line without its terminator and trailing separators."""
    line = text.strip_terminator(F.lower(F.col(VALUE)))
    return F.rtrim(line, F.lit(separator))


def parse_statements(lines: DataFrame, separator: str = " ", uri_prefix: str = text.URI_PREFIX) -> DataFrame:
    """``(s, p, o)`` of the lines with three tokens or more; ``o`` is the rest of the line."""
    parts = F.split(_statement(separator), re.escape(separator), 3)
    return (
        # The generator keeps the optimizer from splitting every line once per use.
        lines.select(F.explode(F.array(parts)).alias("t"))
        .where(F.size("t") == 3)
        .select(
            text.uri_encode(F.col("t")[0], uri_prefix).alias("s"),
            F.col("t")[1].alias("p"),
            F.col("t")[2].alias("o"),
        )
    )


def relation_view(statements: DataFrame, separator: str = " ", uri_prefix: str = text.URI_PREFIX) -> DataFrame:
    """The statements whose object is a single token, that is lines of exactly three tokens."""
    return statements.where(~F.contains("o", F.lit(separator))).select(
        "s", "p", text.uri_encode(F.col("o"), uri_prefix).alias("o")
    )


def parse_relations(lines: DataFrame, separator: str = " ", uri_prefix: str = text.URI_PREFIX) -> DataFrame:
    """``(s, p, o)`` of the lines with exactly three tokens."""
    return relation_view(parse_statements(lines, separator, uri_prefix), separator, uri_prefix)


def parse_ground_truth(
    lines: DataFrame,
    entities1: DataFrame,
    entities2: DataFrame,
    separator: str = ",",
    encode_left: bool = False,
    encode_right: bool = True,
    uri_prefix: str = text.URI_PREFIX,
) -> DataFrame:
    """``(d2_id, d1_id)`` from lines ``uri1 SEP uri2``.

    Pairs with an unknown URI and lines of one field are dropped, and so are
    collection-2 entities with more than one partner.
    """
    parts = F.split(F.lower(F.col(VALUE)), re.escape(separator))
    left, right = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    pairs = lines.select(
        (text.uri_encode(left, uri_prefix) if encode_left else left).alias("uri1"),
        (text.uri_encode(right, uri_prefix) if encode_right else right).alias("uri2"),
    )
    known1 = entities1.select(F.col("uri").alias("uri1"), F.col("entity_id").alias("d1_id"))
    known2 = entities2.select(F.col("uri").alias("uri2"), F.col("entity_id").alias("d2_id"))
    return unambiguous(pairs.join(known1, "uri1").join(known2, "uri2"))


def unambiguous(pairs: DataFrame) -> DataFrame:
    """``(d2_id, d1_id)`` of the collection-2 entities with one distinct partner."""
    return (
        pairs.groupBy("d2_id")
        .agg(F.min("d1_id").alias("d1_id"), F.max("d1_id").alias("last"))
        .where("d1_id = last")
        .select("d2_id", "d1_id")
    )


def parse_ground_truth_ids(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """``(d2_id, d1_id)`` from lines ``id1 SEP id2``."""
    parts = F.split(F.col(VALUE), re.escape(separator))
    return lines.select(
        ids.encode_second(parts[1].cast("bigint")).alias("d2_id"), parts[0].cast("bigint").alias("d1_id")
    )


def parse_matches(lines: DataFrame) -> DataFrame:
    """``(d2_id, d1_id)`` from lines ``(-5,4)``."""
    pattern = r"^\((-?\d+),(-?\d+)\)$"
    return lines.where(F.rlike(F.col(VALUE), F.lit(pattern))).select(
        F.regexp_extract(VALUE, pattern, 1).cast("bigint").alias("d2_id"),
        F.regexp_extract(VALUE, pattern, 2).cast("bigint").alias("d1_id"),
    )


def with_positions(lines: DataFrame) -> DataFrame:
    """Number the lines of one file in reading order; the numbers have gaps.

    Spark packs several files into tasks by size; `read_placed_lines` keeps their order.
    """
    return lines.withColumn("position", F.monotonically_increasing_id())


def read_placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, start, line)``: lines of all files under ``path`` with their place.

    Ordered by ``file``, ``start`` (where the split begins in its file) and
    ``line`` (rising within a split) the lines stand as in the files taken by
    name, however Spark deals files and splits to tasks.
    """
    return spark.read.text(path).select(
        VALUE,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )


# Positions of one input split share their upper bits.
SPLIT_RANGE = 2**33
# Lines of a split that are numbered in one sorted run.
LINE_RANGE = 2**20


def first_appearance(statements: DataFrame) -> DataFrame:
    """``(uri, position)``: where every subject of ``(s, position)`` appears first."""
    return statements.groupBy(F.col("s").alias("uri")).agg(F.min("position").alias("position"))


def _numbered(placed: DataFrame, part: list[str], within: list[str]) -> DataFrame:
    """``(uri, entity_id)``: rows numbered 0, 1, 2, ... by part, then within it.

    Every part starts after the rows of the parts before it, so no task sees
    all rows; only one count per part meets in one place.
    """
    counts = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))
    inside = Window.partitionBy(*part).orderBy(*within, "uri")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, part)
        .select("uri", (F.col("first_id") + F.col("place")).cast("bigint").alias("entity_id"))
    )


def assign_entity_ids(statements: DataFrame, range_size: int = SPLIT_RANGE) -> DataFrame:
    """``(uri, entity_id)``: subjects of ``(s, position)`` numbered 0, 1, 2, ... by first appearance.

    Subjects are numbered within ranges of positions.
    """
    placed = first_appearance(statements).withColumn("part", F.expr(f"position div {range_size}"))
    return _numbered(placed, ["part"], ["position"])


def number_subjects(
    placed_lines: DataFrame,
    separator: str = " ",
    as_written: bool = False,
    uri_prefix: str = text.URI_PREFIX,
) -> DataFrame:
    """``(uri, entity_id)``: subjects of triple files numbered by first appearance.

    ``placed_lines`` come from `read_placed_lines`.  Subjects are lower-cased
    and URI-encoded unless ``as_written``.  The order of the ids is the list of
    distinct subjects in file order.
    """
    split_at = re.escape(separator)
    if as_written:
        subject = F.split(F.col(VALUE), split_at, 2)[0]
    else:
        subject = text.uri_encode(F.split(F.lower(F.col(VALUE)), split_at, 2)[0], uri_prefix)
    placed = (
        placed_lines.select(subject.alias("uri"), F.struct("file", "start", "line").alias("place"))
        .groupBy("uri")
        .agg(F.min("place").alias("place"))
        .select("uri", "place.*")
        .withColumn("run", F.expr(f"line div {LINE_RANGE}"))
    )
    return _numbered(placed, ["file", "start", "run"], ["line"])


def parse_ground_truth_by_subjects(
    lines: DataFrame, subjects1: DataFrame, subjects2: DataFrame, separator: str = ","
) -> DataFrame:
    """``(d2_id, d1_id)`` from lines ``uri1 SEP uri2`` and subjects numbered in triple files.

    ``subjects1`` and ``subjects2`` come from `number_subjects` with
    ``as_written``: no file of ids is needed.  This older form of ids gives
    number ``i`` of collection 2 the id ``-i``, keeps every line, and writes an
    unknown or missing URI as -1 on either side; `parse_ground_truth` filters
    such pairs.
    """
    parts = F.split(F.col(VALUE), re.escape(separator))
    pairs = lines.select(F.get(parts, F.lit(0)).alias("uri1"), F.get(parts, F.lit(1)).alias("uri2"))
    known1 = subjects1.select(F.col("uri").alias("uri1"), F.col("entity_id").alias("d1_id"))
    known2 = subjects2.select(F.col("uri").alias("uri2"), (-F.col("entity_id")).alias("d2_id"))
    unknown = F.lit(-1).cast("bigint")
    return (
        pairs.join(known1, "uri1", "left")
        .join(known2, "uri2", "left")
        .select(F.coalesce("d2_id", unknown).alias("d2_id"), F.coalesce("d1_id", unknown).alias("d1_id"))
    )
