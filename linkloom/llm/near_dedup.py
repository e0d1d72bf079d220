"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the set of its shingles of ``WIDTH`` words (a shorter text is one
shingle).  Shingle x with weight w owns the region [0, w) x [0, inf); hashed
darts of rate one fall into it, the same darts for the same shingle in any
text.  A dart has a rank, a place within the weight and a coordinate of the
signature; each coordinate keeps its dart of lowest rank.  Only ranks below
about (k ln k + 3k) / total weight are looked at, and the limit is doubled as
long as a coordinate is empty.  Two signatures agree in one coordinate with the
weighted Jaccard similarity as probability.  Weights are 1 by default (plain
Jaccard) or the counts of the shingles.

Texts with equal words fold into one representative first.  In each bucket of
equal bands the members are compared with the one that meets most others; what
is similar enough is linked, so a large group of near copies costs its size, not
its square.  Similar texts may miss each other's pivot: members of a bucket that
still lie in different components are joined on their rarest shingles, of which
sets that similar must share one, and the pairs found are compared.  Rarity is
the number of texts that have the shingle, counted exactly.  Every comparison is
exact, over all shingles.

Classes are the connected components of the links.  A band of ROWS coordinates
is equal with probability s**ROWS; with BANDS bands a pair at 0.8 is missed once
in about 200,000.

Defined cases: null, empty and wordless texts have no shingles and form classes
of their own, each row alone; equal texts are always in one class; repeated rows
and null ids are rows like others; an empty table gives an empty result; other
columns are not read by ``near_groups`` and carried along by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.shared import keep_decided, mark
from linkloom.runtime import materialize

WIDTH = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
#: Words whose hashes a task remembers.
KNOWN_WORDS = 500_000
#: Buckets of the counts that ``rarest`` takes (a power of two).
RARITY = 1 << 16

U = np.uint64
#: Odd multipliers of the mixing function, chosen freely.
ODD = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hash 64-bit numbers to 64-bit numbers."""
    x = (x + U(salt * int(ODD[2]) % 2**64)) * ODD[0]
    x = (x ^ (x >> U(32))) * ODD[1]
    return (x ^ (x >> U(29))) * ODD[0] ^ (x >> U(32))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers above 0 and at most 1."""
    return ((x >> U(11)).astype(np.float64) + 1.0) / float(1 << 53)


class Words(dict):
    """Hashes of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(words: list[bytes], known: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and their counts."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    out = np.full(n, U(min(width, len(ids))))
    for i in range(min(width, len(ids))):
        out = (out ^ ids[i : i + n]) * ODD[i % 3]
        out ^= out >> U(31)
    return np.unique(out, return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The id of the earliest dart of each of the ``k`` coordinates."""
    whole = np.ceil(weights).astype(np.int64)
    slab = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
    # one unit of weight of one element; the last unit may be cut short
    units = np.repeat(elements, whole) if len(slab) > len(elements) else elements
    cut = np.repeat(weights, whole) - slab
    if slab.any():
        units = np.where(slab > 0, mixed(units, 0) ^ mixed(slab.astype(np.uint64), 1), units)
    some_cut = bool((cut < 1).any())
    limit = (k * math.log(k) + 3 * k) / float(weights.sum())
    while True:
        ranks, ids = _darts(units, cut if some_cut else None, limit)
        signature = np.zeros(k, np.uint64)
        hit = np.zeros(k, bool)
        latest_first = np.argsort(ranks)[::-1]
        ids = ids[latest_first]
        at = (mixed(ids, 3) % U(k)).astype(np.int64)
        signature[at] = ids  # the earliest comes last
        hit[at] = True
        if hit.all():
            return signature
        limit *= 2


def _darts(units: np.ndarray, cut: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and ids of all darts below ``limit``: arrivals of a Poisson process by unit."""
    ranks, ids = [], []
    rank, alive, turn = np.zeros(len(units)), np.arange(len(units)), 0
    step = max(1, int(limit + 2 * math.sqrt(limit))) if limit > 1 else 1
    while len(alive):
        turns = np.arange(turn, turn + step, dtype=np.uint64)
        dart = mixed(units[alive][:, None] ^ mixed(turns, 4)[None, :], 5)
        at = rank[:, None] - np.cumsum(np.log(unit(mixed(dart, 6))), axis=1)
        inside = at < limit
        if cut is not None:
            lands = inside & (unit(mixed(dart, 7)) <= cut[alive][:, None])
        else:
            lands = inside
        ranks.append(at[lands])
        ids.append(dart[lands])
        on = inside[:, -1]
        rank, alive, turn = at[on, -1], alive[on], turn + step
    return np.concatenate(ranks), np.concatenate(ids)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = signature[: bands * rows].reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = mixed(out ^ grid[:, i], 8 + i)
    return out.view(np.int64)


def _signed(
    width: int, bands: int, rows: int, counted: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        none = np.empty(0, np.int64)
        for batch in batches:
            words_marks, sizes, bands_of, seen = [], [], [], {}
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                digest = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
                if digest not in seen:
                    elements, counts = shingles(words, known, width)
                    found = none
                    if len(elements):
                        weights = counts.astype(float) if counted else np.ones(len(elements))
                        found = band_hashes(dart_signature(elements, weights, bands * rows), bands, rows)
                    seen[digest] = (len(elements), found)
                words_marks.append(digest)
                sizes.append(seen[digest][0])
                bands_of.append(seen[digest][1])
            offsets = np.cumsum([0, *map(len, bands_of)]).astype(np.int32)
            flat = np.concatenate(bands_of) if bands_of else none
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(words_marks, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["row", "doc_id", "mark", "words", "size", "bands"],
            )

    return signed


def _with_shingles(width: int, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words mark and shingles of each text; with counts, the n-th repeat is an element of its own."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            marks, sets = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                elements, counts = shingles(words, known, width)
                if counted:
                    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                    elements = np.repeat(elements, counts) ^ mixed(nth.astype(np.uint64), 2)
                marks.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sets.append(elements.view(np.int64))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(marks, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["row", "words", "shingles"],
            )

    return listed


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles reach the similarity."""

    def of(side: str) -> DataFrame:
        return sets.select(F.col("words").alias(side), F.col("shingles").alias(f"set_{side}"))

    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("common", common)
    all_of = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.filter(F.col("common") >= similarity * all_of - 1e-9).select("a", "b")


def rarest(elements: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """As many of the rarest elements, rarest first, that a set this similar must share one of them.

    The prefix of one set, in an order by counts of buckets; ``_rare_shingles`` is
    the same for a table, in an order by exact counts.
    """
    n = len(elements) - math.ceil(similarity * len(elements) - 1e-9) + 1
    order = np.lexsort((elements, counts[(elements.view(np.uint64) & U(RARITY - 1)).astype(np.int64)]))
    return elements[order[:n]]


def _rare_shingles(open_texts: DataFrame, written_sets: DataFrame, similarity: float) -> DataFrame:
    """``(words, label, n, at, rare)``: the first shingles of every text that lie in several components.

    Shingles of one component come first in the order: they hold a place and make
    no pair, so only the others move.  These follow by the number of texts that
    have them, counted one by one, and by hash.  ``at`` is the place from 0 in
    that order, ``n`` the size of the set; only the first
    ``n - ceil(similarity * n) + 1`` places are listed.
    """
    # short numbers move instead of marks
    components_of = materialize(
        open_texts.select("label").distinct().withColumn("component", F.monotonically_increasing_id()), "open-labels"
    )
    sets = materialize(
        open_texts.join(components_of, "label")
        .join(written_sets.select("words", "shingles").dropDuplicates(["words"]), "words")
        .select("words", "label", "component", F.monotonically_increasing_id().alias("text"), "shingles"),
        "open-sets",
    )
    in_several = (
        sets.select("component", F.explode("shingles").alias("rare"))
        .groupBy("rare")
        .agg(F.count("*").alias("texts"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low != high")
        .select("rare", "texts")
    )
    size = F.size("shingles").cast("long")
    listed = sets.select("text", size.alias("n"), F.explode("shingles").alias("rare")).join(in_several, "rare")
    in_text = Window.partitionBy("text")
    placed = (
        listed.withColumn("nth", F.row_number().over(in_text.orderBy("texts", "rare")))
        .withColumn("alone", F.col("n") - F.count("*").over(in_text))
        .withColumn("at", F.col("alone") + F.col("nth") - 1)
        .filter(F.col("at") < F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1)
    )
    marks = sets.select("text", "words", "label")
    return placed.join(marks, "text").select("words", "label", "n", "at", "rare")


def _rare_pairs(open_texts: DataFrame, written_sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a < b) of ``open_texts`` (words, label) of different labels that share rare shingles.

    In any order of the shingles that is the same for all, sets that reach the
    similarity share one of the first ``n - ceil(similarity * n) + 1`` of either;
    the smaller set even has it in its first ``n - ceil(least * n) + 1`` with
    ``least = 2 * similarity / (1 + similarity)``, and the places leave room for
    all they must share.  The order is that of ``_rare_shingles``.  Texts that
    share a common passage and little else, or not quite enough, do not meet,
    however many there are.
    """
    keyed = materialize(_rare_shingles(open_texts, written_sets, similarity), "rare-shingles")
    least = 2 * similarity / (1 + similarity)
    head = F.col("at") < F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1

    def of(side: str, rows: DataFrame) -> DataFrame:
        return rows.select("rare", *(F.col(c).alias(f"{c}_{side}") for c in ("words", "label", "n", "at")))

    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = room >= F.lit(least / 2) * (F.col("n_a") + F.col("n_b")) - 1e-9
    sized = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= F.lit(similarity) * F.col("n_b") - 1e-9)
    met = of("a", keyed.filter(head)).join(of("b", keyed), "rare").filter(
        (F.col("label_a") != F.col("label_b")) & sized & enough
    )
    return met.select(
        F.least("words_a", "words_b").alias("a"), F.greatest("words_a", "words_b").alias("b")
    ).distinct()


def near_groups(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    counted: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, class_id, group_size, n_verified, kept, mark.

    ``class_id`` is the doc_id of the row that stays (smallest id; null ids
    last); ``group_size`` counts the rows of the
    class, ``n_verified`` the links of the row's text to other texts that were
    compared to form the class (not all links inside it).
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(given.dtypes)["doc_id"]
    signed = materialize(
        given.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", mark("text").alias("mark"), "text"
        ).mapInArrow(
            _signed(width, bands, rows, counted),
            f"row long, doc_id {kind}, mark string, words binary, size long, bands array<long>",
        ),
        "signatures",
    )
    texts = signed.filter("words IS NOT NULL").groupBy("words").agg(
        F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("row").alias("first_row")
    )
    members = materialize(
        texts.select("words", "size", F.explode("bands").alias("bucket")), "bucket-members"
    )
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(members.select("bucket", "words").join(buckets, "bucket"), "shared-buckets")
    # the member that meets most others over all its buckets is the pivot: of copies
    # of one text that text, or what is nearest to it, rather than any of the copies
    met = shared.groupBy("words").agg(F.sum("n").alias("met"))
    pivots = (
        shared.join(met, "words")
        .groupBy("bucket")
        .agg(F.max(F.struct("met", "words")).alias("most"))
        .select("bucket", F.col("most.words").alias("pivot"))
    )
    stars = materialize(
        shared.join(pivots, "bucket")
        .filter("pivot != words")
        .select(F.least("pivot", "words").alias("a"), F.greatest("pivot", "words").alias("b"))
        .distinct(),
        "star-pairs",
    )
    wanted = shared.select("words").distinct()
    # the shingles of every text in a shared bucket, once for each different text
    first = texts.join(wanted, "words", "left_semi").select("first_row")
    by_row = signed.select("row", "doc_id", "mark").join(first, F.col("row") == F.col("first_row"), "left_semi")
    chosen = by_row.select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    found = (
        given.withColumn("mark", mark("text"))
        .join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
        .select(F.col("_row").alias("row"), "text")
    )
    written_sets = materialize(
        found.mapInArrow(_with_shingles(width, counted), "row long, words binary, shingles array<long>"),
        "shingle-sets",
    )
    sets = written_sets.dropDuplicates(["words"])
    links = materialize(_linked(stars, sets, similarity), "star-links")
    labels = components(links)
    # members of one bucket that the stars left apart
    placed = (
        shared.join(labels.withColumnRenamed("node", "words"), "words", "left")
        .withColumn("label", F.coalesce("label", "words"))
        .select("bucket", "words", "label")
    )
    apart = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    open_texts = materialize(
        placed.join(apart.select("bucket"), "bucket", "left_semi").select("words", "label").distinct(),
        "open-texts",
    )
    if not open_texts.isEmpty():
        rest = _rare_pairs(open_texts, written_sets, similarity).join(stars, ["a", "b"], "left_anti")
        more = materialize(_linked(rest, sets, similarity), "other-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return _classes(signed.select("row", "doc_id", "mark", "words"), links, labels)


def _classes(rows: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    degree = links.select(F.explode(F.array("a", "b")).alias("words")).groupBy("words").agg(F.count("*").alias("n_verified"))
    linked = labels.withColumnRenamed("node", "words").join(degree, "words")
    placed = materialize(
        rows.join(linked, "words", "left").select(
            "row",
            "doc_id",
            "mark",
            F.coalesce("label", "words", F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary")).alias("label"),
            F.coalesce("n_verified", F.lit(0)).alias("n_verified"),
        ),
        "near-rows",
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = materialize(
        placed.groupBy("label").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1"),
        "near-groups",
    )
    alone = F.col("group_size").isNull()
    return placed.join(groups, "label", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        "n_verified",
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "mark",
    )


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One row of each class, with all its columns."""
    return keep_decided(docs, near_groups(docs, doc_id=doc_id, text=text, **options), doc_id=doc_id, text=text)
