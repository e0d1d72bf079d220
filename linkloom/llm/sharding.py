"""Reproducible sharding: a Feistel permutation of global row numbers with cycle walking.

Rows are numbered from 0 in the order of their id.  A balanced Feistel network
permutes the smallest power of four that holds all numbers; a result outside
the table is permuted again until it falls inside (fewer than four steps on
average), which makes a permutation of exactly the row numbers.  The permuted
number p gives shard ``p mod shards`` and slot ``p div shards``: counts differ
by one at most, slots have no gaps, and ``place``/``row_at`` compute either way
without a table.

Only ids, sizes and checksums are sorted, never the texts; see
``shared.ordered`` for the numbering.  The same ids give the same places.

Defined cases: a null text has size 1 and checksum 0; null ids come first;
repeated ids are ordered by size and checksum, equal rows in any order; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import ordered, row_numbers

ROUNDS = 4
#: Constants of the round function: odd numbers below 2**31, chosen freely.
MULTIPLIERS = (1_640_531_527, 1_222_345_679)
LOW31 = (1 << 31) - 1


def _keys(seed: int) -> list[int]:
    state, keys = seed & LOW31, []
    for _ in range(ROUNDS):
        state = (state * 1_103_515_245 + 12_345) & LOW31
        keys.append(state)
    return keys


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _mixed(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half + key) & LOW31
    x = (x * MULTIPLIERS[0]) & LOW31
    x ^= x >> 15
    x = (x * MULTIPLIERS[1]) & LOW31
    return (x ^ (x >> 13)) & mask


def _walk(numbers: np.ndarray, n: int, once: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = once(numbers)
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each row number below ``n`` in the shuffle."""
    bits, keys = _half_bits(n), _keys(seed)
    mask = (1 << bits) - 1

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ _mixed(right, key, mask)
        return (left << bits) | right

    return _walk(np.asarray(numbers, np.int64), n, once)


def restore(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each place of the shuffle."""
    bits, keys = _half_bits(n), _keys(seed)
    mask = (1 << bits) - 1

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in reversed(keys):
            left, right = right ^ _mixed(left, key, mask), left
        return (left << bits) | right

    return _walk(np.asarray(places, np.int64), n, once)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    slot, shard = divmod(int(permute(np.array([row]), n, seed)[0]), shards)
    return shard, slot


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number in a slot of a shard."""
    return int(restore(np.array([slot * shards + shard]), n, seed)[0])


def _permuted(number: Column, n: int, seed: int) -> Column:
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return F.pandas_udf(apply, "long")(number)


def shard_documents(
    docs: DataFrame, *, shards: int = 16, seed: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, row_number, size, text_crc32, shard, slot."""
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    given = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(bytes_of) + 1).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
    )
    keys = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = ordered(given, keys, "shard-rows")
    n = placed.count()
    number = _permuted(F.col("row_number"), n, seed)
    return (
        row_numbers(placed)
        .withColumn("_place", number)
        .select(
            "doc_id",
            "row_number",
            "size",
            "text_crc32",
            (F.col("_place") % shards).cast("int").alias("shard"),
            F.expr(f"_place div {shards}").alias("slot"),
        )
    )
