"""Whitening of embeddings with exact cross-products from bit slices.

An entry ``c`` becomes the whole number ``floor(SCALE * c) + OFFSET``.  A block
of rows is shifted by the least value of each dimension; what remains is cut
into bit planes, and each plane of each dimension is packed across the rows
into 64-bit words.  The cross-product of two dimensions is then the sum of
``2**(a + b) * popcount(plane a & plane b)``: whole numbers, whatever the order.
Blocks add up as decimals in a Spark aggregate of one row per pair of
dimensions, so the totals are exact at any number of rows.  They are centred as
integers (``n * C - S * S'``), divided once, and given to ``eigh``; what reaches
the driver is bounded by the square of the dimension, never by the rows.

The whitened rows are written once; the identity error is measured on them.

Defined cases: rows whose vector is null, empty or holds a null or a number
that is not finite are dropped, as are vectors of another length than the most
frequent one (of equally frequent ones the shortest); they are no members of
one list.  Entries beyond 2**40 / SCALE in magnitude count as that bound.  Only
components with an eigenvalue above rounding are returned, so a constant
dimension gives none, and a single row or equal rows give no rows at all.  Ids
may be null or repeated, each row is returned.  ``deviation`` is a decimal (null
beyond 38 digits).  An empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
LARGEST = 1 << 40
#: Numbers of one block: bounds the memory of a task.
BLOCK_ENTRIES = 1 << 22
CELL = "i int, j int, total decimal(38,0)"


def whole_vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable rows of a batch and ``floor(SCALE * c)`` of their entries."""
    lists = batch.column("embedding")
    fits = pc.equal(pc.list_value_length(lists), size).fill_null(False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64())
    entries = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # null: nan
    good = np.isfinite(entries).all(1)
    scaled = np.floor(entries[good] * SCALE)
    return at[good], np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """``(planes, dimensions, words)``: bit ``a`` of every row of ``values`` (none negative), 64 rows a word."""
    rows, size = values.shape
    count = int(values.max(initial=0)).bit_length()
    words = -(-rows // 64)
    planes = np.zeros((count, size, words), np.uint64)
    for a in range(count):
        bits = np.packbits(((values >> a) & 1).astype(np.uint8), axis=0, bitorder="little")
        padded = np.zeros((words * 8, size), np.uint8)
        padded[: len(bits)] = bits
        planes[a] = np.ascontiguousarray(padded.T).view("<u8")
    return planes


def sliced_products(values: np.ndarray) -> list[list[int]]:
    """``sum over rows of v_i * v_j`` for ``j >= i``, by weighted counts of common bits."""
    planes = bit_planes(values)
    count, size, _ = planes.shape
    totals = [[0] * size for _ in range(size)]
    for a in range(count):
        for i in range(size):
            if not planes[a, i].any():
                continue
            common = np.bitwise_count(planes[a, i] & planes[:, i:]).sum(axis=2, dtype=np.int64)
            for b in range(count):
                for j, found in enumerate(common[b].tolist(), i):
                    totals[i][j] += found << (a + b)
    return totals


def _cells(block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Exact ``(i, j, sum)`` of a block; ``j = -1`` is the sum of a dimension, ``(-1, -1)`` the rows."""
    rows, size = block.shape
    least = block.min(axis=0)
    sums = [int(s) for s in (block - least).sum(axis=0)]
    low = [int(m) for m in least]
    yield -1, -1, rows
    for i, line in enumerate(sliced_products(block - least)):
        yield i, -1, sums[i] + rows * low[i]
        for j in range(i, size):
            yield i, j, line[j] + low[i] * sums[j] + low[j] * sums[i] + rows * low[i] * low[j]


def _scatter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    limit = max(64, BLOCK_ENTRIES // size)

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        i, j, totals = zip(*_cells(np.concatenate(parts)), strict=True)
        kind = pa.decimal128(38, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(totals, pa.decimal256(76, 0)).cast(kind)],
            names=["i", "j", "total"],
        )

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, len(batch), limit):
                values = whole_vectors(batch.slice(at, limit), size)[1]
                if len(values):
                    parts.append(values)
                if sum(map(len, parts)) >= limit:
                    yield packed(parts)
                    parts = []
        if parts:
            yield packed(parts)

    return scatter


@dataclass
class Whitening:
    """``n`` rows with sums ``S`` of ``floor(SCALE * c)``, eigenvalues and unit eigenvectors of their covariance."""

    size: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def components(n: int, sums: list[int], products: dict[tuple[int, int], int], limit: int | None) -> Whitening:
    """Eigenvectors of the covariance that exact sums give, by falling eigenvalue."""
    size = len(sums)
    cov = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            # whole numbers until the one division, which rounds correctly
            cov[i, j] = cov[j, i] = (n * products[i, j] - sums[i] * sums[j]) / n**2
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > values[0] * size * np.finfo(float).eps * 8
    keep = int(real.sum()) if limit is None else min(limit, int(real.sum()))
    return Whitening(size, n, sums, values[:keep], vectors[:, :keep], float(np.trace(cov)))


def fit(vectors: DataFrame, limit: int | None = COMPONENTS, *, embedding: str = "embedding") -> Whitening | None:
    """The whitening of all usable rows of ``vectors`` (None: there are none)."""
    given = vectors.select(F.col(embedding).alias("embedding"))
    length = F.size("embedding")
    usual = given.filter(length > 0).groupBy(length.alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return None
    cells = given.mapInArrow(_scatter(usual["size"]), CELL).groupBy("i", "j").agg(F.sum("total").alias("total"))
    totals = {(r["i"], r["j"]): int(r["total"]) for r in cells.collect()}  # at most size * (size + 3) / 2 + 1 rows
    if not totals:
        return None
    n, sums = totals[-1, -1], [totals[i, -1] for i in range(usual["size"])]
    return components(n, sums, totals, limit)


def deviations(model: Whitening, values: np.ndarray) -> list[int]:
    """Exact ``sum over dimensions of (n * x - S)**2`` of each row."""
    n = model.n
    middle = np.array([s // n for s in model.sums], np.int64)
    rest = [s % n for s in model.sums]
    near = values - middle  # n * x - S = n * near - rest
    reach = n * (int(np.abs(near).max(initial=0)) + 1)
    if model.size * reach**2 < 1 << 63:
        return ((n * near - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]


def _whitened(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    middle = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n / model.n for s in model.sums])
    turn = model.vectors / np.sqrt(model.values)
    rows_at_once = max(1, BLOCK_ENTRIES // model.size)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), rows_at_once):
                batch = whole.slice(start, rows_at_once)
                at, values = whole_vectors(batch, model.size)
                found = ((values - middle) - rest) @ turn
                far = [d if d < 10**38 else None for d in deviations(model, values)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at)),
                        pa.array(far, pa.decimal128(38, 0)),
                        pa.array(list(found), pa.list_(pa.float64())),
                    ],
                    names=["vec_id", "deviation", "whitened"],
                )

    return whitened


def _second_moments(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the sums and products of the whitened entries, which are centred already."""
    i, j = np.triu_indices(size)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            rows = pc.list_flatten(batch.column("whitened")).to_numpy(zero_copy_only=False).reshape(-1, size)
            sums += rows.sum(axis=0)
            products += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([i, np.arange(size)]), pa.int32()),
                pa.array(np.concatenate([j, np.full(size, -1)]), pa.int32()),
                pa.array(np.concatenate([products[i, j], sums])),
            ],
            names=["i", "j", "total"],
        )

    return moments


def identity_error(rows: DataFrame, n: int, size: int) -> float:
    """Largest absolute entry of the covariance of ``rows.whitened`` minus the identity."""
    cells = (
        rows.select("whitened")
        .mapInArrow(_second_moments(size), "i int, j int, total double")
        .groupBy("i", "j")
        .agg(F.sum("total").alias("total"))
    )
    totals = {(r["i"], r["j"]): r["total"] for r in cells.collect()}  # bounded by the components
    mean = [totals[i, -1] / n for i in range(size)]
    return max(abs(totals[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(size) for j in range(i, size))


def whiten(
    vectors: DataFrame, limit: int | None = COMPONENTS, *, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per usable vector: vec_id, n, deviation, whitened array, explained array, identity_error."""
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    model = fit(given, limit)
    kind = dict(given.dtypes)["vec_id"]
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None or not len(model.values):
        error, explained, n = 0.0, [], 0
        rows = given.filter(F.lit(False)).selectExpr(
            "vec_id", "cast(null as decimal(38,0)) as deviation", "cast(array() as array<double>) as whitened"
        )
    else:
        rows = materialize(given.mapInArrow(_whitened(model), schema), "whitened")
        explained, n = (model.values / model.trace).tolist(), model.n
        error = identity_error(rows, n, len(explained))
    return rows.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(float(e)) for e in explained]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def by_component(rows: DataFrame) -> DataFrame:
    """The result of ``whiten`` with one row per vector and component, numbered from 1."""
    pairs = F.arrays_zip("whitened", "explained")
    return rows.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(pairs).alias("place", "pair")
    ).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )
