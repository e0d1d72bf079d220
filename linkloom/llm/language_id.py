"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and cut to its letters with one blank around each word;
its subwords are all runs of 1 to 4 characters inside ``" word "``.  Each is
hashed to one of BUCKETS embeddings of SIZE numbers; the mean of the embeddings
goes through a linear softmax.  Embeddings and weights are trained together by
stochastic gradient descent in numpy.

Training uses a bounded sample: from each language every labelled row whose
hash falls under PER_LANGUAGE / (rows of the language), thus about PER_LANGUAGE
rows each at any size of the input; of each the whole text and one short span,
so that short texts are learned too.  One task in ten parts is held back to fit
a temperature (scores are then calibrated probabilities) and the rejection
limit: the lowest score from which on the held-back rows are right with
``precision``.  Predictions read whole texts; the model is one small matrix.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is everything when no row can be learned from; rows with a null language are
not learned; null and repeated ids are drawn by their texts; repeated rows are predicted one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

BUCKETS = 1 << 14
SIZE = 16
LONGEST = 4
PER_LANGUAGE = 800
EPOCHS = 8
BATCH = 64
RATE = 2.0
PRECISION = 0.99
SPAN = 60

#: What parts words: all but letters and the marks on them.
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def subwords(text: str | None) -> np.ndarray:
    """Counts by bucket of the subwords of a text (all zero: no letter)."""
    clean = NO_LETTER.sub(" ", (text or "").lower()).strip()
    if not LETTER.search(clean):
        return np.zeros(BUCKETS, np.float32)
    points = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = points == 32
    found = np.zeros(BUCKETS, np.int64)
    code = np.zeros(len(points), np.uint32)
    inside = np.ones(len(points), bool)
    for n in range(1, LONGEST + 1):
        if n > len(points):
            break
        last = points[n - 1 :]
        code = (code[: len(last)] + last + np.uint32(1)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        # a blank may only be the first or the last character
        inside = inside[: len(last)]
        if n > 2:
            inside = inside & ~blank[n - 2 : len(points) - 1]
        use = inside if n > 1 else ~blank
        found += np.bincount((code[use] >> np.uint32(3)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return found.astype(np.float32)


@dataclass
class Model:
    """``weights`` is the product of embeddings and softmax: one row per bucket."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    power = np.exp(logits - logits.max(1, keepdims=True))
    return power / power.sum(1, keepdims=True)


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], precision: float = PRECISION) -> Model:
    """Fit a model to sparse counts (buckets, numbers) and their languages."""
    languages = sorted(set(labels))
    y = np.array([languages.index(label) for label in labels])
    rng = np.random.default_rng(0)
    embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    out, bias = np.zeros((SIZE, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, row in enumerate(rows):
            x[i, counts[row][0]] = counts[row][1]
        return x / np.maximum(x.sum(1, keepdims=True), 1)

    order = rng.permutation(len(y))
    held = order[: len(y) // 10]
    learned = order[len(held) :]
    steps = EPOCHS * max(1, -(-len(learned) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        for at in range(0, len(learned), BATCH):
            rows = learned[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            x = dense(rows)
            mean = x @ embed
            slope = softmax(mean @ out + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            used = np.flatnonzero(x.any(0))
            # rows of embeddings get small gradients, as each is a small part of a mean
            embed[used] -= rate * 20 * (x[:, used].T @ (slope @ out.T))
            out -= rate * (mean.T @ slope)
            bias -= rate * slope.sum(0)
    model = Model(languages, embed @ out, bias, 1.0, 0.0)
    if len(held):
        logits = np.concatenate(
            [dense(held[i : i + BATCH]) @ model.weights + bias for i in range(0, len(held), BATCH)]
        )
        truth = y[held]

        def loss(t: float) -> float:
            return -float(np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean())

        model.temperature = min((2.0**e for e in np.arange(-3, 3.01, 0.25)), key=loss)
        found = softmax(logits / model.temperature)
        best, right = found.max(1), found.argmax(1) == truth
        falling = np.argsort(-best)
        share = np.cumsum(right[falling]) / np.arange(1, len(held) + 1)
        good = np.flatnonzero(share >= precision)
        model.limit = float(best[falling[good[-1]]]) if len(good) else 1.0
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of the whole text and of one short span."""
    for batch in batches:
        langs, buckets, numbers = [], [], []
        for text, lang, draw in zip(
            batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("draw").to_pylist(), strict=True
        ):
            start = draw % max(1, len(text) - SPAN)
            for part in (text, text[start : start + SPAN]):
                found = subwords(part)
                used = np.flatnonzero(found)
                if len(used):
                    langs.append(lang)
                    buckets.append(used.astype(np.int32))
                    numbers.append(found[used])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()),
                pa.array([b.tobytes() for b in buckets], pa.binary()),
                pa.array([n.tobytes() for n in numbers], pa.binary()),
            ],
            names=["lang", "buckets", "numbers"],
        )


def fit(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    precision: float = PRECISION,
) -> Model | None:
    """Train on about ``per_language`` rows of each language (None: nothing to learn from)."""
    labelled = docs.select(
        F.col(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text), F.lit(11)), F.lit(1 << 30)).alias("draw"),
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    drawn = (
        labelled.join(F.broadcast(sizes), "lang")  # one row for each language
        .filter(F.col("draw") * F.col("_n") < F.lit(per_language * (1 << 30)))
        .drop("_n")
    )
    rows = drawn.mapInArrow(_features, "lang string, buckets binary, numbers binary").collect()
    # rows with a fixed order, however the tasks ended
    rows.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["numbers"])))
    if not rows:
        return None
    counts = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["numbers"], np.float32)) for r in rows]
    return train(counts, [r["lang"] for r in rows], precision)


def _predicted(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                counts = np.stack([subwords(t.as_py()) for t in part.column("text")])
                known = counts.any(1) & (model is not None)
                names, scores, refused = ["und"] * len(known), np.zeros(len(known)), np.ones(len(known), bool)
                if known.any():
                    found = model.probabilities(counts)
                    best = found.argmax(1)
                    names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                    scores = np.where(known, found.max(1), 0.0)
                    refused = ~known | (scores < model.limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(names, pa.string()),
                        pa.array(scores.astype(float), pa.float64()),
                        pa.array(refused, pa.bool_()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return predicted


def predict(
    docs: DataFrame, model: Model | None, held_out: Column | None = None, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    given = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.lit(False) if held_out is None else held_out).alias("held_out"),
        F.col(text).alias("text"),
    )
    kind = dict(given.dtypes)["doc_id"]
    return given.mapInArrow(
        _predicted(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def identify(docs: DataFrame, held_out: Column, **names: str) -> DataFrame:
    """Learn from the rows that are not held out, predict all.

    The result is written, so that a lost task cannot mix two models.
    """
    text_names = {k: v for k, v in names.items() if k != "lang"}
    return materialize(predict(docs, fit(docs.filter(~held_out), **names), held_out, **text_names), "languages")
