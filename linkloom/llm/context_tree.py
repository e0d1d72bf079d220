"""Scoring of texts by context-tree weighting over bytes.

Each byte is eight binary decisions; a decision (one of 255 places in the byte)
has a context tree over the bytes before it, the latest first, of a depth that
the caller chooses (3 to 5, by default DEPTH).  Every node of a tree estimates
its decision with the Krichevsky-Trofimov rule and mixes, with equal prior
weight, its own estimate and those of its children:

    Pw(node) = 1/2 KT(node) + 1/2 product of Pw(children)

The weights that follow from the training texts are then fixed, and a byte is
predicted by the mixture along its path of contexts through all depths; a
context that no training text has is even.  A text is lower-cased (A-Z), preceded
by as many end bytes 0xFF as the tree is deep and followed by one; UTF-8 never
uses that byte.  The score is the log10 probability of the text with its end;
divided by the bytes it is the code length per byte.

What is gathered grows with the texts: one row for every different gram (context
and byte), with how often training has it and how often all texts have it.
Equal grams are folded in the task before they are shuffled.

* Contexts of three bytes and more: the grams are dealt by their latest three
  bytes and sorted, so that a tree comes together and passes through numpy in
  chunks of whole three-byte contexts (at most 256**(depth - 2) grams each:
  65,536 at depth 4, 16.8 M at depth 5 if every byte followed every other).  Out come the sums for the two-byte contexts and, for
  each gram, the probabilities of its eight bits below depth two.
* The upper levels are at most 2**16 contexts, added up by latest byte; the root
  is put together in the driver from 256 rows.
* A join by (two bytes, byte) completes the log probability of each gram.
* A gram that makes up at least 1 / HEAD_GRAMS of all bytes is common; there
  cannot be more than HEAD_GRAMS of them, so they are broadcast as an open hash
  table (at most 2**23 places, 100 MB).  The other grams of each text meet their log probabilities in a join, in which by
  definition no key is hot.

The word counts beside it work alike.  A word that makes up at least 1 / HEAD of
all training words is common and broadcast; the rare words of each text meet
their counts in a join.  Words are told apart by 64-bit hashes.

Defined cases: a null text counts as empty (one token: the end); null ids are
text "" for the folds of the caller, a row whose fold is null is held out;
repeated rows are scored one by one; very long texts are cut into grams a
megabyte at a time, and each piece lists its rare grams in a row of its own;
without training rows every decision is even and every count 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

DEPTH = 5
DEPTHS = range(3, 6)
HEAD = 1 << 18
HEAD_GRAMS = 1 << 22
END = b"\xff"
#: Word key of the end token.
END_KEY = 0
#: Words, and grams, a task counts before it hands them on.
HELD_WORDS = 1_000_000
HELD_GRAMS = 1 << 22
#: Bytes of a text that are cut into grams at a time.
PIECE = 1 << 20
#: Grams that pass through the trees at a time, but for whole three-byte contexts.
CHUNK = 1 << 16

UPPER = bytes(range(65, 91))
TO_LOWER = bytes.maketrans(UPPER, UPPER.lower())
KIND_BYTES, KIND_WORD = 0, 1
BITS = np.arange(8)


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(TO_LOWER)


def grams(raw: bytes, depth: int) -> Iterator[np.ndarray]:
    """A number for each byte of the text and its end, piece by piece.

    From the top: latest byte before it, the one before that, ..., the byte itself.
    """
    whole = END * depth + raw + END
    for at in range(0, len(raw) + 1, PIECE):
        b = np.frombuffer(whole[at : at + PIECE + depth], np.uint8).astype(np.int64)
        n = len(b) - depth
        key = b[depth:].copy()
        for back in range(1, depth + 1):
            key |= b[depth - back : depth - back + n] << (8 * (depth + 1 - back))
        yield key


def word_keys(words: Counter) -> np.ndarray:
    """64-bit hashes of the words as signed numbers, none of them that of the end."""
    unsigned = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    keys = (unsigned ^ np.uint64(1 << 63)).view(np.int64)
    keys[keys == END_KEY] = 1
    return keys


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and their summed counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kind, key, n, times) sums of a task: n in training, times in all texts."""

    def rows(kind: int, key: np.ndarray, n: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 100_000):
            cut = slice(at, at + 100_000)
            columns = np.full(len(key[cut]), kind, np.int32), key[cut], n[cut], times[cut]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n", "times"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ends, parts, held, sums = Counter(), 0, [], 0, []

        def word_rows() -> Iterator[pa.RecordBatch]:
            n = np.fromiter(words.values(), np.int64, len(words))
            yield from rows(KIND_WORD, word_keys(words), n, n)

        def gram_rows() -> Iterator[pa.RecordBatch]:
            # the lowest bit of a counted gram says that the text is held out
            for key, n in sums:
                yield from rows(KIND_BYTES, key >> 1, np.where(key & 1, 0, n), n)

        for batch in batches:
            for text, out in zip(batch.column("text"), batch.column("held_out")):
                raw, out = lowered(text.as_py()), out.as_py()
                if not out:
                    words.update(raw.split())
                    ends += 1
                    if len(words) > HELD_WORDS:
                        yield from word_rows()
                        words.clear()
                for key in grams(raw, depth):
                    parts.append(key << 1 | out)
                    held += len(key)
                    if held > HELD_GRAMS:
                        new = np.unique(np.concatenate(parts), return_counts=True)
                        sums, parts, held = [_folded([*sums, new])], [], 0
                        if len(sums[0][0]) > HELD_GRAMS:
                            yield from gram_rows()
                            sums = []
        if parts:
            sums = [_folded([*sums, np.unique(np.concatenate(parts), return_counts=True)])]
        yield from gram_rows()
        yield from word_rows()
        if ends:
            yield from rows(KIND_WORD, *(np.array([x]) for x in (END_KEY, ends, ends)))

    return counted

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5, by Stirling's series after a shift."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        low = y < 7
        shift[low] += np.log(y[low])
        y[low] += 1
    i2 = 1 / (y * y)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def decisions_of(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and bits of the eight decisions of bytes: (n,) to (n, 8) each."""
    byte = byte[:, None]
    return (1 << BITS) + (byte >> (8 - BITS)), (byte >> (7 - BITS)) & 1


HALF = np.log(0.5)


def node(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the weight of their own estimate."""
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(HALF + own, HALF + children)
    return weighted, np.exp(HALF + own - weighted)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Estimate that the next decision is one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def deep_nodes(key: np.ndarray, n: np.ndarray, depth: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The trees below depth two for sorted grams of whole three-byte contexts.

    Returns the sums of the three-byte contexts by (two-byte context, place), and
    the probability of each of the eight bits of each gram, (grams, 8).
    """
    places, bits = decisions_of(key & 255)
    times = np.repeat(n[:, None], 8, 1)
    ids, inner = np.unique((key[:, None] >> 8 << 8) | places, return_inverse=True)
    inner = inner.reshape(-1)
    zeros = np.bincount(inner, (times * (1 - bits)).reshape(-1), len(ids))
    ones = np.bincount(inner, (times * bits).reshape(-1), len(ids))
    weighted, own = log_kt(zeros, ones), np.ones(len(ids))
    levels = [(inner, own, kt_one(zeros, ones))]
    for _ in range(depth, 3, -1):
        ids, parent = np.unique((ids >> 16 << 8) | (ids & 255), return_inverse=True)
        zeros, ones, children = (np.bincount(parent, x, len(ids)) for x in (zeros, ones, weighted))
        weighted, own = node(zeros, ones, children)
        levels.append((parent, own, kt_one(zeros, ones)))
    mixed, left = np.zeros(len(ids)), np.ones(len(ids))
    for parent, own, one in reversed(levels):
        mixed, left = mixed + left * own * one, left * (1 - own)
        mixed, left = mixed[parent], left[parent]
    p_one = mixed.reshape(-1, 8)
    ids, up = np.unique((ids >> 16 << 8) | (ids & 255), return_inverse=True)
    sums = {"node": ids} | {
        name: np.bincount(up, x, len(ids)) for name, x in (("zeros", zeros), ("ones", ones), ("weighted", weighted))
    }
    return sums, np.where(bits == 1, p_one, 1 - p_one)


DEEP = "node long, zeros double, ones double, weighted double, key long, times long, p array<float>"


def _deep(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of node sums (key null) and of grams (node null) from grams sorted by key."""

    def table(key: np.ndarray, n: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums, p = deep_nodes(key, n, depth)
        of_nodes = [pa.array(sums[c]) for c in ("node", "zeros", "ones", "weighted")]
        offsets = pa.array(np.arange(0, 8 * len(key) + 1, 8, dtype=np.int32))
        of_grams = [
            pa.array(key),
            pa.array(times),
            pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1).astype(np.float32))),
        ]
        types = [a.type for a in (*of_nodes, *of_grams)]
        names = ["node", "zeros", "ones", "weighted", "key", "times", "p"]
        none = [pa.nulls(len(sums["node"]), t) for t in types[4:]]
        yield pa.RecordBatch.from_arrays([*of_nodes, *none], names=names)
        none = [pa.nulls(len(key), t) for t in types[:4]]
        yield pa.RecordBatch.from_arrays([*none, *of_grams], names=names)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "n", "times")])
            size += batch.num_rows
            if size < CHUNK:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            of = columns[0] >> (8 * (depth - 2))
            cut = int(np.searchsorted(of, of[-1]))  # the last three-byte context may go on
            if cut:
                yield from table(*(c[:cut] for c in columns))
            held, size = [[c[cut:] for c in columns]], len(of) - cut
        if size:
            yield from table(*(np.concatenate(c) for c in zip(*held)))

    return deep


def _upper(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Depths two and one of one latest byte: listed nodes and dense values of both levels."""
    ids = group["node"].to_numpy()
    at = (ids >> 8) & 255, ids & 255
    zeros, ones, children = np.zeros((3, 256, 256))
    for dense, name in ((zeros, "zeros"), (ones, "ones"), (children, "weighted")):
        dense[at] = group[name].to_numpy()
    weighted, own = node(zeros, ones, children)
    z1, o1 = zeros.sum(0), ones.sum(0)
    weighted1, own1 = node(z1, o1, weighted.sum(0))
    return ids, own, kt_one(zeros, ones), z1, o1, weighted1, own1


def _summaries(group: pa.Table) -> pa.Table:
    _, _, _, z1, o1, weighted1, _ = _upper(group)
    return pa.table({n: pa.array([x.tobytes()], pa.binary()) for n, x in (("z", z1), ("o", o1), ("w", weighted1))})


def _predictions(root_one: np.ndarray, root_own: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Of each (two bytes, byte): for its bits, the probability from depths zero to two and the share of what is deeper."""

    def predictions(group: pa.Table) -> pa.Table:
        ids, own, one, z1, o1, _, own1 = _upper(group)
        mixed = root_own * root_one + (1 - root_own) * own1 * kt_one(z1, o1)
        left = (1 - root_own) * (1 - own1)
        mixed, left = mixed + left * own * one, left * (1 - own)
        last = np.sort(ids[(ids & 255) >= 128])  # the place of the last bit tells the byte but for that bit
        pair = ((last >> 8 << 8)[:, None] | (((last & 127) << 1)[:, None] + [0, 1])).reshape(-1)
        places, bits = decisions_of(pair & 255)
        at = ((pair >> 8) & 255)[:, None], places
        share, upper = left[at], mixed[at]
        upper = np.where(bits == 1, upper, 1 - share - upper)
        return pa.table(
            {"pair": pa.array(pair)}
            | {n: pa.array(list(x), pa.list_(pa.float64())) for n, x in (("upper", upper), ("share", share))}
        )

    return predictions


def gram_logs(sums: DataFrame, depth: int) -> DataFrame:
    """(key, times, log): log10 P(byte | context) of every gram, from rows (key, n, times).

    Only 256 rows of three times 256 numbers pass through the driver.
    """
    by_context = sums.repartition(F.shiftright("key", 8 * (depth - 2))).sortWithinPartitions("key")
    deep = materialize(by_context.select("key", "n", "times").mapInArrow(_deep(depth), DEEP), "context-nodes")
    nodes = materialize(
        deep.filter("key IS NULL").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))),
        "context-pairs",
    )
    by_latest = nodes.groupBy(F.shiftright("node", 16).alias("latest"))
    zeros, ones, children = np.zeros((3, 256))
    for r in by_latest.applyInArrow(_summaries, "z binary, o binary, w binary").collect():
        zeros += np.frombuffer(r["z"])
        ones += np.frombuffer(r["o"])
        children += np.frombuffer(r["w"])
    _, own = node(zeros, ones, children)
    upper = by_latest.applyInArrow(
        _predictions(kt_one(zeros, ones), own), "pair long, upper array<double>, share array<double>"
    )
    pair = F.shiftright("key", 8 * (depth - 1)).bitwiseAND(F.lit(0xFFFF)) * 256 + F.col("key").bitwiseAND(F.lit(255))
    log = sum((F.log10(F.col("upper")[i] + F.col("share")[i] * F.col("p")[i]) for i in range(8)), F.lit(0.0))
    grams_of_texts = deep.filter("key IS NOT NULL").select("key", "times", "p", pair.alias("pair"))
    return materialize(grams_of_texts.join(upper, "pair").select("key", "times", log.alias("log")), "context-logs")

def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    """First place of each key in a table of ``size`` (a power of two) places."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open table of different keys >= 0, at most half full; free places hold -1."""
    size = 2 << max(len(keys) - 1, 0).bit_length()
    table, out = np.full(size, -1, np.int64), np.zeros(size, values.dtype)
    at, left = _slot(keys, size), np.arange(len(keys))
    while len(left):
        free = left[table[at[left]] == -1]
        table[at[free]] = keys[free]  # of keys that meet in a place one stays
        placed = table[at[left]] == keys[left]
        out[at[left[placed]]] = values[left[placed]]
        left = left[~placed]
        at[left] = (at[left] + 1) & (size - 1)
    return table, out


def from_table(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted keys are in the table, and the values of those."""
    at = _slot(wanted, len(table))
    found = table[at]
    hit = found == wanted
    left = np.flatnonzero(~hit & (found != -1))
    while len(left):
        at[left] = (at[left] + 1) & (len(table) - 1)
        found = table[at[left]]
        same = found == wanted[left]
        hit[left[same]] = True
        left = left[~same & (found != -1)]
    return hit, values[at[hit]]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted keys are among the sorted keys, and the values of those."""
    if not len(keys):
        return np.zeros(len(wanted), bool), values[:0]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, values[at[hit]]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _scored(
    common_grams: object, common: object, total: int, kinds: int, depth: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of each text, with its rare words and rare grams, which are still to be looked up.

    Further pieces of a long text give rows of their own with nothing but their rare grams.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gram_keys, gram_log), (keys, numbers) = common_grams.value, common.value
        log_of = np.log10((numbers + 0.5) / (total + 0.5 * (kinds + 1)))
        for batch in batches:
            n_tokens, n_known, base, score, n_bytes, rare, times, rare_grams = [], [], [], [], [], [], [], []
            later_rows, later_grams = [], []
            for row, text in zip(batch.column("row"), batch.column("text")):
                raw = lowered(text.as_py())
                words = Counter(raw.split())
                found = np.append(word_keys(words), END_KEY)
                n = np.fromiter((*words.values(), 1), np.int64, len(found))
                hit, logs = _looked_up(keys, log_of, found)
                n_tokens.append(int(n.sum()))
                n_known.append(int(n[hit].sum()))
                base.append(float((n[hit] * logs).sum()))
                rare.append(found[~hit])
                times.append(n[~hit])
                n_bytes.append(len(raw))
                summed = 0.0
                for piece, key in enumerate(grams(raw, depth)):
                    hit, logs = from_table(gram_keys, gram_log, key)
                    summed += float(logs.sum(dtype=np.float64))
                    if piece == 0:
                        rare_grams.append(key[~hit])
                    else:
                        later_rows.append(row.as_py())
                        later_grams.append(key[~hit])
                score.append(summed)
            columns = [
                *(batch.column(c) for c in ("row", "doc_id", "held_out")),
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(score, pa.float64()),
                pa.array(n_bytes, pa.int64()),
                _lists(rare),
                _lists(times),
                _lists(rare_grams),
            ]
            names = ["row", "doc_id", "held_out", "n_tokens", "common", "base", "score", "n_bytes", "rare", "times", "grams"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if later_rows:
                none = [pa.nulls(len(later_rows), c.type) for c in columns[1:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(later_rows, pa.int64()), *none, _lists(later_grams)], names=names)

    return scored


def score_documents(
    docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH
) -> DataFrame:
    """One row per document, learned from those not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte (null for an empty text).
    """
    if depth not in DEPTHS:
        raise ValueError(f"depth must be from {DEPTHS[0]} to {DEPTHS[-1]}")
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    sums = materialize(
        given.select("text", F.coalesce("held_out", F.lit(True)).alias("held_out"))
        .mapInArrow(_counted(depth), "kind int, key long, n long, times long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"), F.sum("times").alias("times")),
        "context-sums",
    )
    words = sums.filter(F.col("kind") == KIND_WORD).select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = words.filter(F.col("n") * HEAD >= total).toPandas().sort_values("key")  # at most HEAD rows
    logs = gram_logs(sums.filter(F.col("kind") == KIND_BYTES), depth)
    length = logs.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    is_common = F.col("times") * HEAD_GRAMS >= length
    common_grams = logs.filter(is_common).select("key", F.col("log").cast("float")).toArrow()  # at most HEAD_GRAMS rows
    tree = spark.sparkContext.broadcast(hash_table(*(common_grams[c].to_numpy() for c in ("key", "log"))))
    head = spark.sparkContext.broadcast((common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    kind = dict(given.dtypes)["doc_id"]
    scored = materialize(
        given.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            _scored(tree, head, total, kinds, depth),
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, common long, base double, score double, "
            "n_bytes long, rare array<long>, times array<long>, grams array<long>",
        ),
        "context-scores",
    )
    looked_up = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
        .join(words.filter(F.col("n") * HEAD < total), "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
            F.sum(
                F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
            ).alias("log"),
        )
    )
    rare_logs = (
        scored.select("row", F.explode("grams").alias("key"))
        .join(logs.filter(~is_common).select("key", "log"), "key")
        .groupBy("row")
        .agg(F.sum("log").alias("rare_log"))
    )
    scores = scored.filter("n_tokens IS NOT NULL").drop("rare", "times", "grams")
    score = F.col("score") + F.coalesce("rare_log", F.lit(0.0))
    return scores.join(looked_up, "row", "left").join(rare_logs, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
