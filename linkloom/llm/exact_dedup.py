"""Exact deduplication by 128-bit content hash, with a comparison of the bytes.

Two texts are equal when they are identical without white space.  Rows meet by
the MD5 (128 bits) of that normalised text; inside each hash group the bytes
are compared, and a group that holds different texts is parted by the text
itself, so a collision never merges two texts.

Only hashes and ids are grouped over all rows.  Texts are moved once, to find
those of the repeated hashes, and meet there as a running minimum and maximum:
partial aggregation keeps two texts per hash and task, so a group with a third
of all rows costs no more than any other.

Defined cases: a null text counts as empty, and all such rows form one group;
a null id sorts last and is never equal to another row; rows that agree in text
and id are told apart by their place in the input, and one of them stays; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import SPACE, keep_decided, mark
from linkloom.runtime import materialize


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def content_hash(text: Column) -> Column:
    """The 128-bit hash of a normalised text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id_key")


def exact_groups(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, mark.

    Of equal texts the row with the most code points stays, then the one with
    the smallest id.  ``mark`` tells apart texts that differ in white space only.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    plain = given.withColumn("plain", normalized(F.col("text")))
    rows = materialize(
        plain.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            mark("text").alias("mark"),
            hash_of(F.col("plain")).alias("hash"),
            F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256"),
            F.coalesce(F.length("text"), F.lit(0)).alias("points"),
        ),
        "exact-rows",
    )
    repeated = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    wanted = rows.join(repeated, "hash", "left_semi").select("hash", _id_key()).distinct()
    # the texts of repeated hashes, dealt by id and hash: a hot group spreads over all tasks
    found = (
        plain.select("plain", hash_of(F.col("plain")).alias("hash"), _id_key())
        .join(wanted.hint("shuffle_hash"), ["hash", "id_key"], "left_semi")
        .select("plain", "hash")
    )
    mixed = materialize(
        found.groupBy("hash")
        .agg(F.min("plain").alias("low"), F.max("plain").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("hash"),
        "exact-collisions",
    )
    if mixed.isEmpty():
        return _decided(rows.withColumn("variant", F.lit("")))
    # a true collision: such rows are told apart by their whole text
    texts = materialize(
        plain.select("doc_id", "plain", hash_of(F.col("plain")).alias("hash"))
        .join(mixed, "hash", "left_semi")
        .select("doc_id", "hash", "plain")
        .distinct(),
        "exact-variants",
    )
    told = texts.select(
        F.col("doc_id").alias("_id"),
        F.col("hash").alias("_hash"),
        F.sha2(F.col("plain").cast("binary"), 256).alias("_sha"),
        F.col("plain").alias("variant"),
    )
    parted = rows.join(
        told,
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.col("hash") == F.col("_hash"))
        & (F.col("text_sha256") == F.col("_sha")),
        "left",
    ).withColumn("variant", F.coalesce("variant", F.lit("")))
    return _decided(parted.drop("_id", "_hash", "_sha"))


def _decided(rows: DataFrame) -> DataFrame:
    best = F.min(
        F.struct(
            (-F.col("points")).alias("shorter"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id"),
            F.col("row"),
        )
    )
    # written, so that the join below reads two plain shuffles and a hot group can be split
    groups = materialize(
        rows.groupBy("hash", "variant")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .filter("group_size > 1"),
        "exact-groups",
    )
    alone = F.col("group_size").isNull()
    return rows.join(groups, ["hash", "variant"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
        "mark",
    )


def drop_exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_decided(docs, exact_groups(docs, doc_id=doc_id, text=text), doc_id=doc_id, text=text)
