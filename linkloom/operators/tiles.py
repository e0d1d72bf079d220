"""Sums over the pairs of two collections, in tiles.

Where most pairs share a link, a row for each pair and link is far more than the
posts and the lists.  Here the entities of one side are cut into groups and those
of the other into parts, whose posts are packed by link.  The task of a group reads
the written parts one after the other, adds up the weights of its entities with
each and keeps the best, or a count.  So lists are final where they are made, and
of the posts only those of a group are shuffled, once; the work is that of all
pairs, the memory that of one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import ids
from linkloom.runtime import materialize, swept

#: Entities of one group and of one part, at most; the places in a part are numbers of 16 bits.
ROWS = 4096
COLUMNS = 32768
#: A collection of few entities makes GROUPS groups, a larger one up to SPREAD of LEAST_ROWS at least.
GROUPS = 6
SPREAD = 24
LEAST_ROWS = 512
#: Entries of the lists that a task holds at once.
CELLS = 1 << 22
#: Whole numbers up to this are exact as doubles.
LARGEST_EXACT = 9e15
#: Sums that may be larger are added up in two halves, the lower one of so many bits.
HALF = 26
#: When counting, a link with at least one of so many entities of a part is a row of bits.
BITS = 64


def _numbered(posts: DataFrame) -> DataFrame:
    """``(entity_id, links, weights)``: links as numbers, the weights beside them.

    The number of a link is its hash, unless two links have the same.
    """
    used = posts.where("entity_id IS NOT NULL AND link IS NOT NULL")
    names = used.select("link").distinct()
    with swept(used.sparkSession):
        told_apart = names.groupBy(F.xxhash64("link")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if told_apart:
        used = used.withColumn("number", F.xxhash64("link"))
    else:
        numbers = materialize(names.withColumn("number", F.monotonically_increasing_id()), "link-numbers")
        used = used.join(numbers, "link")
    held = F.collect_list(F.struct("number", F.col("weight").cast("double").alias("weight")))
    lists = used.groupBy("entity_id").agg(held.alias("held"))
    return lists.select("entity_id", F.col("held.number").alias("links"), F.col("held.weight").alias("weights"))


def _spread(of: Column, n: int) -> Column:
    """Which of n groups an entity falls in."""
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def _groups(n_rows: int, k: int) -> int:
    """How many groups: even work for some tasks, and lists that fit one."""
    spread = max(GROUPS, min(SPREAD, n_rows // LEAST_ROWS))
    return max(spread, -(-n_rows // max(1, min(ROWS, CELLS // k))))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists."""
    column = table.column(name).combine_chunks()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


ROW_FIELDS = {"ids": np.int64, "sizes": np.int64, "links": np.int64, "norms": np.int64}
PART_FIELDS = {
    "part_ids": np.int64,
    "names": np.int64,
    "counts": np.int64,
    "weights": np.float64,
    "places": np.uint16,
    "part_norms": np.int64,
}


def _blobs(fields: dict[str, type], values: dict[str, np.ndarray]) -> pa.Table:
    """One row with the arrays as bytes."""
    return pa.table({f: pa.array([np.ascontiguousarray(values[f], t).tobytes()], pa.binary()) for f, t in fields.items()})


def _arrays(batch: pa.RecordBatch, i: int, fields: dict[str, type]) -> dict[str, np.ndarray]:
    return {f: np.frombuffer(batch.column(f)[i].as_buffer(), t) for f, t in fields.items()}


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entities of a group as one row."""
    table = pa.Table.from_batches(found) if (found := list(batches)) else None
    if table is not None and len(table):
        sizes, links = _lists(table, "links")
        own = {n: table.column(n).to_numpy() for n in ("entity_id", "norm")}
        packed = {"ids": own["entity_id"], "sizes": sizes, "links": links, "norms": own["norm"]}
        yield from _blobs(ROW_FIELDS, packed).to_batches()


def _packed_part(table: pa.Table) -> pa.Table:
    """The entities of a part by rising ids, and their places under each link, as one row."""
    found = table.column("entity_id").to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    sizes, links = _lists(table, "links")
    weights = _lists(table, "weights")[1]
    places = np.repeat(place, sizes)
    by_link = np.lexsort((places, links))
    names, first, counts = np.unique(links[by_link], return_index=True, return_counts=True)
    return _blobs(
        PART_FIELDS,
        {
            "part_ids": found[order],
            "names": names,
            "counts": counts,
            "weights": weights[by_link[first]],
            "places": places[by_link],
            "part_norms": table.column("norm").to_numpy()[order],
        },
    )


def _schema(fields: dict[str, type]) -> str:
    return ", ".join(f"{f} binary" for f in fields)


def _parts(lists: DataFrame, n: int) -> DataFrame:
    """The written parts of a collection, one row each."""
    parts = lists.withColumn("part", _spread(F.col("entity_id"), max(1, -(-n // COLUMNS))))
    return materialize(parts.groupBy("part").applyInArrow(_packed_part, _schema(PART_FIELDS)), "link-parts")


def _met(rows: DataFrame, parts: DataFrame, n_groups: int, kernel: Callable, schema: str) -> DataFrame:
    """Every group of ``rows`` with every part, through ``kernel``.

    One task for each group: the product of two tables keeps the rows of a partition of its
    right side, here one, and reads the left side, here one partition, past them.
    """
    group = _spread(F.col("entity_id"), n_groups)
    groups = rows.drop("weights").repartitionById(n_groups, group).mapInArrow(_packed_rows, _schema(ROW_FIELDS))
    return parts.coalesce(1).crossJoin(groups.hint("shuffle_replicate_nl")).mapInArrow(kernel, schema)


class _Rows:
    """A group: its entities and their links."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        held = _arrays(batch, i, ROW_FIELDS)
        self.ids, self.links, self.norms = held["ids"].copy(), held["links"].copy(), held["norms"].copy()
        self.at = np.concatenate([[0], np.cumsum(held["sizes"])])

    def within(self, part: _Part) -> Iterator[tuple[int, np.ndarray]]:
        """Each entity that has links of the part, with the places of these links there."""
        found = np.searchsorted(part.names, self.links)
        found[found == len(part.names)] = 0
        common = part.names[found] == self.links
        at = np.concatenate([[0], np.cumsum(common)])[self.at]
        found = found[common]
        for row in np.flatnonzero(np.diff(at)).tolist():
            yield row, found[at[row] : at[row + 1]]


class _Part:
    """The entities of a part under each link."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        held = _arrays(batch, i, PART_FIELDS)
        self.ids, self.names, self.counts = held["part_ids"], held["names"], held["counts"]
        self.weights, self.places, self.norms = held["weights"], held["places"], held["part_norms"]
        self.n = len(self.ids)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        under = np.repeat(np.arange(len(self.names)), self.counts) * self.n + self.places
        new = np.flatnonzero(np.diff(under, prepend=-1))  # sorted by link and place
        #: How often an entity stands under a link, at most.
        self.most = int(np.diff(new, append=len(under)).max(initial=0))
        self.buffer = np.empty(0, np.int64)

    def of(self, links: np.ndarray) -> np.ndarray:
        """The places under the links, once for each; good until the next call."""
        n = int(self.counts[links].sum())
        if n > len(self.buffer):
            self.buffer = np.empty(2 * n, np.int64)
        bounds = zip(self.starts[links].tolist(), self.ends[links].tolist(), strict=True)
        return np.concatenate([self.places[a:b] for a, b in bounds], out=self.buffer[:n])

    def repeats(self) -> np.ndarray:
        """How often each of ``places`` stands under its link."""
        under = np.repeat(np.arange(len(self.names)), self.counts) * self.n + self.places
        _, at, counts = np.unique(under, return_inverse=True, return_counts=True)
        return counts[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met, rows = 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            rows, part = rows or _Rows(batch, i), _Part(batch, i)
            met += _distinct(rows, part) if _is_single(rows, part) else _repeated(rows, part)
    yield pa.record_batch({"met": pa.array([met], pa.int64())})


def _is_single(rows: _Rows, part: _Part) -> bool:
    """Whether no entity has two posts under a link."""
    if part.most > 1:
        return False
    owner = np.repeat(np.arange(len(rows.ids)), np.diff(rows.at))
    order = np.lexsort((rows.links, owner))
    owner, links = owner[order], rows.links[order]
    return not np.any((owner[1:] == owner[:-1]) & (links[1:] == links[:-1]))


def _distinct(rows: _Rows, part: _Part) -> int:
    common = np.flatnonzero(part.counts * BITS >= part.n)
    bits = np.zeros((len(common), -(-part.n // 64) * 8), np.uint8)
    of_link = np.full(len(part.names), -1)
    of_link[common] = np.arange(len(common))
    for row, link in enumerate(common.tolist()):
        mask = np.zeros(bits.shape[1] * 8, bool)
        mask[part.places[part.starts[link] : part.ends[link]]] = True
        bits[row] = np.packbits(mask)
    words = bits.view(np.uint64)
    met, mask = 0, np.zeros(bits.shape[1] * 8, bool)
    for _, links in rows.within(part):
        kept = of_link[links]
        rare = links[kept < 0]
        mask[:] = False
        if len(rare):
            mask[part.of(rare)] = True
        seen = np.packbits(mask).view(np.uint64)
        for row in kept[kept >= 0].tolist():
            seen |= words[row]
        met += int(np.bitwise_count(seen).sum())
    return met


def _repeated(rows: _Rows, part: _Part) -> int:
    """As `_distinct`; a pair with p and q posts under its heaviest common link counts p + q - 1 times."""
    lightest_first = np.lexsort((-np.arange(len(part.weights)), part.weights))
    standing = np.argsort(lightest_first)
    posts = part.repeats()
    met, counts = 0, np.zeros(part.n, np.int64)
    for _, found in rows.within(part):
        links, own = np.unique(found, return_counts=True)
        order = np.argsort(standing[links])
        for link, times in zip(links[order], own[order], strict=True):
            under = slice(part.starts[link], part.ends[link])
            counts[part.places[under]] = posts[under] + times - 1  # the heaviest comes last and stays
        met += int(counts.sum())
        counts[:] = 0
    return met


def count_met(members: DataFrame, n1: int, n2: int) -> DataFrame:
    """One row ``v``: how many pairs of ``(entity_id, link, weight)`` share a link.

    With repeated posts a pair counts as `_repeated` says.
    """
    lists = materialize(_numbered(members).withColumn("norm", F.lit(0).cast("bigint")), "link-lists")
    first = ids.is_first(F.col("entity_id"))
    met = _met(lists.where(first), _parts(lists.where(~first), n2), _groups(n1, 1), _count, "met long")
    return met.agg(F.coalesce(F.sum("met"), F.lit(0)).cast("bigint").alias("v"))


def _leading(score: np.ndarray, k: int, least: float) -> np.ndarray:
    """Places, rising, of scores from ``least`` on; the k best are among them, and all that equal the k-th."""
    step = len(score) // (8 * k)
    if step > 1:
        some = score[::step]
        rank = min(len(some), 3 * k // (2 * step) + 8)
        bar = np.partition(some, len(some) - rank)[len(some) - rank]
        if bar > least:
            found = np.flatnonzero(score >= bar)
            if len(found) >= k:
                return found
    return np.flatnonzero(score >= least)


class _Best:
    """The k best partners of every entity of a group so far; ties go to the smaller id."""

    def __init__(self, rows: _Rows, k: int, with_norms: bool) -> None:
        self.rows, self.k, self.with_norms = rows, k, with_norms
        n = len(rows.ids)
        self.ids, self.values = np.empty((n, k), np.int64), np.empty((n, k))
        self.held = np.zeros(n, np.int64)
        #: What a partner needs at least, before it is rounded.
        self.least = np.full(n, -np.inf)

    def meet(self, part: _Part) -> None:
        free, none = not part.weights.all(), np.nextafter(0, 1)
        lowest_norm = part.norms.min() if part.n else 0.0
        for row, links in self.rows.within(part):
            places, weights = part.of(links), part.weights[links]
            counts = part.counts[links]
            if weights.sum() * part.most < LARGEST_EXACT:
                score = np.bincount(places, np.repeat(weights, counts), part.n)
            else:
                high, low = (
                    np.bincount(places, np.repeat(half, counts), part.n).astype(np.int64) for half in np.divmod(weights, 1 << HALF)
                )
                score = (high << HALF) + low
            shared = None
            if free and not weights.all():  # a pair may share links without weight alone
                shared = np.bincount(places, minlength=part.n) > 0
            if self.with_norms:
                own = self.rows.norms[row]
                if own + lowest_norm > 0:
                    score = score / (own + part.norms)
                else:
                    norms = own + part.norms
                    shared = score > 0 if shared is None else shared
                    score = np.divide(score, norms, out=np.zeros(part.n), where=norms != 0)
            if shared is not None:
                score[~shared] = -1
            found = _leading(score, self.k, max(self.least[row], none if shared is None else 0.0))
            if len(found):
                self._add(row, part.ids[found], score[found])

    def _add(self, row: int, found: np.ndarray, score: np.ndarray) -> None:
        k, n = self.k, self.held[row]
        value = score if self.with_norms else ((score.astype(np.int64) + 500) // 1000).astype(float)
        if len(value) > k:
            kth = np.partition(value, len(value) - k)[len(value) - k]
            chosen = np.flatnonzero(value >= kth)
            found, value = found[chosen], value[chosen]
        if n:
            found, value = np.concatenate([self.ids[row, :n], found]), np.concatenate([self.values[row, :n], value])
            order = np.lexsort((found, -value))[:k]
        else:
            order = np.argsort(-value, kind="stable")[:k]  # by rising ids
        n = self.held[row] = len(order)
        self.ids[row, :n], self.values[row, :n] = found[order], value[order]
        if n == k:
            self.least[row] = self.values[row, k - 1]
            if not self.with_norms:
                slack = 500 if self.values[row, k - 1] * 1000 < LARGEST_EXACT else 5000  # for doubles that are not exact
                self.least[row] = self.values[row, k - 1] * 1000 - slack

    def batches(self) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // self.k)
        for start in range(0, len(self.held), step):
            held = self.held[start : start + step]
            kept = np.arange(self.k) < held[:, None]
            values = self.values[start : start + step][kept]
            yield pa.record_batch(
                {
                    "entity_id": pa.array(np.repeat(self.rows.ids[start : start + step], held), pa.int64()),
                    "cand_id": pa.array(self.ids[start : start + step][kept], pa.int64()),
                    "score": pa.array(values if self.with_norms else values * 1000 / 1e12, pa.float64()),
                    "rank": pa.array(np.nonzero(kept)[1] + 1, pa.int32()),
                }
            )


def _best(k: int, with_norms: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            for i in range(batch.num_rows):
                top = top or _Best(_Rows(batch, i), k, with_norms)
                top.meet(_Part(batch, i))
        if top:
            yield from top.batches()

    return best


def top_in_tiles(posts: DataFrame, k: int, norms: DataFrame | None, n1: int, n2: int) -> DataFrame:
    """``(entity_id, cand_id, score, rank)``: the K best partners of every entity.

    Each weight must be less than LARGEST_EXACT, sums and norms must fit 64 bits.
    """
    lists = _numbered(posts)
    if norms is None:
        lists = lists.withColumn("norm", F.lit(0).cast("bigint"))
    else:
        lists = lists.join(norms.select("entity_id", F.col("norm").cast("bigint").alias("norm")), "entity_id")
    lists = materialize(lists, "link-lists")
    first, second = lists.where(ids.is_first(F.col("entity_id"))), lists.where(ids.is_second(F.col("entity_id")))
    schema = "entity_id long, cand_id long, score double, rank int"
    kernel = _best(k, norms is not None)
    forward = _met(first, _parts(second, n2), _groups(n1, k), kernel, schema)
    return forward.unionByName(_met(second, _parts(first, n1), _groups(n2, k), kernel, schema))
