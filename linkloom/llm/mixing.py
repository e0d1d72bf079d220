"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_bytes``.  A source with weight w may
start its block k (from 0) at slot floor(k/w) and must have placed it by slot
ceil((k+1)/w); taking the released block with the earliest deadline keeps every
source within less than one block of its target share at every slot.

Releases and deadlines are computed from the exact ratios of the given weights,
in whole numbers, so no rounding adds up however long the mix is.  Earliest
deadline first goes slot by slot: the driver lays out the schedule and writes it piece by
piece as rows (source, block, slot), one per ``block_bytes`` of text; it holds
one entry per source and HELD_SLOTS rows, and its time grows with the number of
blocks and the square of the number of sources.  When a source is used up, a new phase begins,
in which the others share the slots by their renormalised weights; the bound
holds in each phase, counted from its start.  No row is left out or repeated.

Inside a source documents come in a seeded hash order.  Their byte offsets are
running totals over a range partitioning by (source, hash), so a hot source is
spread over many tasks.

Defined cases: null sources form one source; a null text has one byte, as every
text counts its bytes plus one; a source without a target gets the smallest
target of the others; a target of zero or less is refused; repeated rows
stay together; an empty table gives an empty result; other columns are
carried along.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from linkloom.llm.shared import mark, ordered, running_totals, shuffle_partitions
from linkloom.runtime import fresh_path

BLOCK_BYTES = 65_536
#: Slots of the schedule that are handed on at a time.
RESOLUTION = 1_024
#: Rows of the schedule that the driver holds before it writes them.
HELD_SLOTS = 500_000
#: Exponent of the default targets: sizes to this power, which raises small sources.
ALPHA = 0.5

def integer_parts(weights: Mapping[object, float], total: int) -> dict[object, int]:
    """Whole parts of ``total`` by largest remainder, at least one each."""
    all_weights = math.fsum(weights.values())
    spare = total - len(weights)
    exact = {k: w / all_weights * spare for k, w in weights.items()}
    parts = {k: 1 + int(x) for k, x in exact.items()}
    by_remainder = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))
    for k in by_remainder[: total - sum(parts.values())]:
        parts[k] += 1
    return parts


def one_round(parts: Mapping[object, int]) -> dict[object, list[int]]:
    """Earliest deadline first over one round: the slots of each source."""
    total = sum(parts.values())
    names = sorted(parts, key=str)
    released: list[tuple[int, int, int]] = []
    waiting = [(0, i, 0) for i in range(len(names))]
    heapq.heapify(waiting)
    places: dict[object, list[int]] = {k: [] for k in names}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(released, (-((k + 1) * total // -parts[names[i]]), i, k))
        _, i, k = heapq.heappop(released)
        places[names[i]].append(slot)
        if k + 1 < parts[names[i]]:
            heapq.heappush(waiting, ((k + 1) * total // parts[names[i]], i, k + 1))
    return places


def exact_shares(weights: Mapping[object, float | Fraction]) -> dict[object, int]:
    """Whole numbers in exactly the ratios of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: w.numerator * (common // w.denominator) for k, w in exact.items()}
    divisor = math.gcd(*whole.values())
    return {k: n // divisor for k, n in whole.items()}


def earliest_deadlines(left: Mapping[object, int], shares: Mapping[object, int]) -> Iterator[object]:
    """The source of each slot, until the first of them has placed all its blocks."""
    names = sorted(left, key=str)
    parts = [shares[k] for k in names]
    total = sum(parts)
    released: list[tuple[int, int, int]] = []
    waiting = [(0, i, 0) for i in range(len(names))]
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(released, (-((k + 1) * total // -parts[i]), i, k))
        _, i, k = heapq.heappop(released)
        yield names[i]
        slot += 1
        if k + 1 == left[names[i]]:
            return
        heapq.heappush(waiting, ((k + 1) * total // parts[i], i, k + 1))


def stretches(
    blocks: Mapping[object, int], weights: Mapping[object, float | Fraction], resolution: int = RESOLUTION
) -> Iterator[tuple[int, int, dict[object, tuple[int, list[int]]]]]:
    """The schedule by runs of at most ``resolution`` slots.

    Each is (first slot, slots, {source: (first block, places after the first slot)}).
    """
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    shares = exact_shares({k: weights[k] for k in left})
    offset = 0
    while left:
        turns = earliest_deadlines(dict(left), shares)
        ended = False
        while not ended:
            places: dict[object, list[int]] = {}
            n = 0
            while n < resolution and (k := next(turns, turns)) is not turns:
                places.setdefault(k, []).append(n)
                n += 1
            ended = n < resolution
            if n:
                yield offset, n, {k: (done[k], at) for k, at in places.items()}
            for k, at in places.items():
                done[k] += len(at)
                left[k] -= len(at)
            offset += n
        left = {k: n for k, n in left.items() if n}


def phases(
    blocks: Mapping[object, int], weights: Mapping[object, float | Fraction], resolution: int = RESOLUTION
) -> dict[object, list[tuple[int, int, int, int, int, list[int]]]]:
    """For each source its (first block, last block, parts, round, offset, places) by stretch."""
    out: dict[object, list[tuple[int, int, int, int, int, list[int]]]] = {k: [] for k, n in blocks.items() if n > 0}
    for offset, n, by_source in stretches(blocks, weights, resolution):
        for k, (first, places) in by_source.items():
            out[k].append((first, first + len(places), len(places), n, offset, places))
    return out


def default_targets(sizes: Mapping[object, int], alpha: float = ALPHA) -> dict[object, float]:
    return {k: float(max(1, n)) ** alpha for k, n in sizes.items()}


def _schedule(
    spark: SparkSession,
    sizes: Mapping[object, int],
    targets: Mapping[object, float | Fraction] | None,
    block_bytes: int,
    resolution: int,
    source_type: T.DataType,
) -> DataFrame:
    """A written table (source, block, slot), one row per block."""
    given = default_targets(sizes) if targets is None else dict(targets)
    if any(w <= 0 for w in given.values()):
        raise ValueError("targets must be above zero")
    smallest = min(given.values(), default=1.0)
    names = list(sizes)
    weights = {k: given.get(k, smallest) for k in names}
    blocks = {k: -(-n // block_bytes) for k, n in sizes.items()}
    schema = T.StructType(
        [
            T.StructField("_source", source_type),
            T.StructField("_block", T.LongType()),
            T.StructField("slot", T.LongType()),
        ]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema]
    path = fresh_path(spark, "mix-schedule")
    spark.createDataFrame([], schema).write.parquet(path)

    def write(*columns: list[object]) -> None:
        table = pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=schema.names)
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)

    source, block, slot = [], [], []
    for offset, _, by_source in stretches(blocks, weights, resolution):
        for k, (first, places) in by_source.items():
            source += [k] * len(places)
            block += range(first, first + len(places))
            slot += [offset + place for place in places]
        if len(slot) >= HELD_SLOTS:
            write(source, block, slot)
            source, block, slot = [], [], []
    if slot:
        write(source, block, slot)
    return spark.read.schema(schema).parquet(path)


def mix_units(
    docs: DataFrame,
    *,
    targets: Mapping[object, float | Fraction] | None = None,
    block_bytes: int = BLOCK_BYTES,
    resolution: int = RESOLUTION,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, mark, size, copies, source_offset, block, slot.

    ``slot`` is the place of the document's block in the mix, ``source_offset``
    its first byte in the order of its source; (slot, source_offset) orders the
    mix.  A document belongs to the block that its first byte falls in.  Rows
    that agree in id, source and text stay together as ``copies`` of one unit.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    units = (
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), mark(text).alias("mark"), size.alias("size")
        )
        .groupBy("doc_id", "source", "mark")
        .agg(F.max("size").alias("size"), F.count("*").alias("copies"))
        .withColumn("_bytes", F.col("size") * F.col("copies"))
        .withColumn("_order", F.xxhash64("doc_id", "mark", F.lit(seed)))
    )
    placed = ordered(units, [F.col("source"), F.col("_order"), F.col("doc_id"), F.col("mark")], "mix-rows")
    totals = placed.groupBy("source").agg(F.sum("_bytes").alias("n"))
    sizes = {r["source"]: r["n"] for r in totals.collect()}  # one row per source
    schedule = _schedule(spark, sizes, targets, block_bytes, resolution, units.schema["source"].dataType)
    lined = running_totals(placed, "source", "_bytes", "source_offset").drop("_bytes", "_order")
    return _slots(lined, schedule, block_bytes)


def _slots(lined: DataFrame, schedule: DataFrame, block_bytes: int) -> DataFrame:
    blocked = lined.withColumn("block", F.expr(f"source_offset div {block_bytes}"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    return blocked.join(schedule, same).drop("_source", "_block")


def in_mixed_order(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    places: tuple[str, str] | None = None,
    **options: object,
) -> DataFrame:
    """All rows of ``docs`` with their columns, laid out in the order of the mix.

    Only ids, marks and sizes are scheduled; a text moves to meet its place and
    again to be laid out.  With ``places``, the names of two more columns for
    slot and source_offset (columns of these names are replaced), the order
    travels in them and the texts move once.
    """
    mixed = mix_units(docs, doc_id=doc_id, text=text, source=source, **options).select(
        F.col("doc_id").alias("of_id"),
        F.col("source").alias("of_source"),
        F.col("mark").alias("of_mark"),
        "slot",
        "source_offset",
    )
    same = (
        F.col("id").eqNullSafe(F.col("of_id"))
        & F.col("from").eqNullSafe(F.col("of_source"))
        & (F.col("mark") == F.col("of_mark"))
    )
    given = docs.drop(*places) if places else docs
    joined = given.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("from"), mark(text).alias("mark")
    ).join(mixed, same)
    if places:
        return joined.select("row.*", *(F.col(c).alias(name) for c, name in zip(("slot", "source_offset"), places, strict=True)))
    n = shuffle_partitions(docs.sparkSession)
    laid_out = joined.repartitionByRange(n, "slot", "source_offset").sortWithinPartitions("slot", "source_offset")
    return laid_out.select("row.*")
