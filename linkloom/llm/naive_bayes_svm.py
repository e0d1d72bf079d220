"""Quality classifier: a linear support vector machine over naive Bayes scaled n-grams.

A text gives indicators of three kinds of n-grams, hashed to BUCKETS bits:

* runs of 1 to 3 characters, as they stand;
* runs of 1 to 3 words by their form: capitals, letters, digits, others, with
  repeats folded (``Thnd***`` is ``Aa*``);
* runs of 1 to 4 words by the distance to the last place of the same word, in
  powers of two, which tell repeated words and lines whatever the words are.

Each indicator is scaled by the log of the ratio of its shares in the two
classes, rows are brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent.  A tenth of the sample is held back to turn
margins into probabilities; the shares of the classes in all labels correct
them for the equal sample.

The fit uses a bounded sample: of either class the ``per_class`` labelled rows
with the smallest hash, whole texts.  A row is BUCKETS bits, so the sample is
at most ``2 * per_class * BUCKETS / 8`` bytes (25 MB).  The share of the
classes counts all labels.  Scores read every whole text.

Defined cases: a null text counts as empty and is scored like one; a label that
is null or neither 0 nor 1 is not learned, nor is an id whose labels say 0 as
often as 1; an id that is repeated among the documents is learned once for each
of its different texts; null ids have no label.  With labels of no class or one
only the score is the share of class 1 (0.5 without labels).  An empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

BUCKETS = 1 << 15
PER_CLASS = 3000
CHARACTERS = 3
FORMS = 3
DISTANCES = 4
COST = 1.0
EPOCHS = 30
#: Fixed value: from which score on a document is predicted good.
LIMIT = 0.3

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER, _LOWER, _DIGIT = (re.compile(p) for p in (r"[A-ZÀ-Þ]+", r"[^\W\d_A]+", r"\d+"))
_REPEAT = re.compile(r"(.)\1+", re.DOTALL)


def form(word: str) -> str:
    """Letters and digits folded to their kind, repeats to one."""
    kinds = _LOWER.sub("a", _UPPER.sub("A", word))
    return _REPEAT.sub(r"\1", _DIGIT.sub("0", kinds))


def _mix(code: np.ndarray, last: np.ndarray) -> np.ndarray:
    code = (code + last + np.uint32(1)) * np.uint32(0x9E3779B1)
    return code ^ (code >> np.uint32(15))


def _runs(tokens: np.ndarray, longest: int, salt: int) -> Iterator[np.ndarray]:
    """Hashed buckets of all runs of 1 to ``longest`` tokens."""
    code = np.full(len(tokens), salt, np.uint32)
    for n in range(1, min(longest, len(tokens)) + 1):
        last = tokens[n - 1 :]
        code = _mix(code[: len(last)], last)
        yield (code >> np.uint32(3)) % np.uint32(BUCKETS)


def indicators(text: str | None) -> np.ndarray:
    """Which of the BUCKETS n-grams occur in a text."""
    seen = np.zeros(BUCKETS, bool)
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for code in _runs(points, CHARACTERS, 17):
        seen[code] = True
    forms: dict[str, int] = {}
    known: dict[str, tuple[int, int]] = {}
    shapes, gaps = [], []
    for at, match in enumerate(WORD.finditer(text)):
        word = match.group()
        before = known.get(word)
        if before is None:
            shape = form(word)
            kind = forms.setdefault(shape, int.from_bytes(shape.encode()[-12:], "little") * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFFFFF)
            gap = 0
        else:
            kind, gap = before[0], (at - before[1]).bit_length()
        known[word] = (kind, at)
        shapes.append(kind)
        gaps.append(gap)
    for code in _runs(np.array(shapes, np.uint32), FORMS, 29):
        seen[code] = True
    for code in _runs(np.array(gaps, np.uint32), DISTANCES, 43):
        seen[code] = True
    return seen


@dataclass
class Model:
    """``weights`` of the scaled indicators for class 1, ``ratio`` that scales them, and the map of margins to scores."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, places: np.ndarray) -> float:
        value = self.ratio[places]
        return float(value @ self.weights[places]) / max(float(np.sqrt(value @ value)), 1e-300) + self.bias

    def score(self, seen: np.ndarray) -> float:
        power = self.slope * self.margin(np.flatnonzero(seen)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(power, -700, 700))))


def count_ratio(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log of the ratio of the smoothed shares of each indicator in class 1 and class 0."""
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for places, kind in zip(rows, good, strict=True):
        (p if kind else q)[places] += 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(
    rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float, epochs: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss ``|w|^2 / 2 + cost * sum max(0, 1 - y w x)``.

    ``x`` is the row's ``ratio`` at its places, of unit length, and a 1 for the
    bias.  One dual variable between 0 and ``cost`` per row is set to its best
    value in turn.
    """
    weights, bias = np.zeros(len(ratio)), 0.0
    dual = np.zeros(len(y))
    unit = np.array([1.0 / max(float(np.sqrt(ratio[p] @ ratio[p])), 1e-300) for p in rows])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(y)):
            x = ratio[rows[i]] * unit[i]
            slope = y[i] * (weights[rows[i]] @ x + bias) - 1.0
            step = min(max(dual[i] - slope / (x @ x + 1.0), 0.0), cost) - dual[i]
            if step:
                weights[rows[i]] += step * y[i] * x
                bias += step * y[i]
                dual[i] += step
                largest = max(largest, abs(step))
        if largest < 1e-3 * cost:
            break
    return weights, bias


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(rows: list[np.ndarray], good: np.ndarray, share: float, cost: float = COST) -> Model:
    """Fit to the places of the indicators of each row; ``share`` is the part of class 1 among all labels."""
    if not len(good) or good.all() or not good.any():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, offset=float(np.log(share / (1 - share))))
    order = np.random.default_rng(0).permutation(len(good))
    held, learned = order[: len(good) // 10], order[len(good) // 10 :]
    if any(part.all() or not part.any() for part in (good[held], good[learned])):
        held = learned = order  # too few to hold some back
    kept = [rows[i] for i in learned]
    ratio = count_ratio(kept, good[learned])
    model = Model(ratio, *dual_descent(kept, ratio, np.where(good[learned], 1.0, -1.0), cost, EPOCHS))
    model.slope, model.offset = _logistic(np.array([model.margin(rows[i]) for i in held]), good[held])
    # the sample has other shares of the classes than all labels
    drawn = good.mean()
    model.offset += float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(indicators(t.as_py())).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(bits, pa.binary())], names=["good", "bits"])


def verdicts(labels: DataFrame, held_out: Column, *, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``doc_id, good`` of the ids to learn from: one row an id, without ties."""
    votes = (
        labels.filter(~held_out & F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.sum(F.when(F.col(quality) == 1, 1).otherwise(-1)).alias("_votes"))
    )
    return votes.filter("_votes != 0").select("doc_id", (F.col("_votes") > 0).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows of ``docs`` (doc_id, text) that are not held out.

    Only ids and hashes of texts are joined with the labels; texts are read for
    the drawn rows alone, which have a fixed bound.
    """
    docs = docs.select("doc_id", "text")
    marked = docs.select("doc_id", F.xxhash64("text").alias("_mark"), held_out.alias("_out"))
    learn = materialize(
        marked.filter("NOT _out").drop("_out").distinct().join(verdicts(labels, held_out), "doc_id"), "labelled"
    )
    shares = {r["good"]: r["count"] for r in learn.groupBy("good").count().collect()}
    total = sum(shares.values())
    if not total:
        return train([], np.zeros(0, bool), 0.5)
    draw = [F.xxhash64("doc_id", "_mark", F.lit(3)), F.col("doc_id"), F.col("_mark")]
    drawn = learn.filter("good").orderBy(*draw).limit(per_class)
    drawn = materialize(drawn.unionByName(learn.filter("NOT good").orderBy(*draw).limit(per_class)), "drawn")
    texts = docs.withColumn("_mark", F.xxhash64("text")).join(F.broadcast(drawn), ["doc_id", "_mark"])
    # one row of each drawn id and text, however often it is repeated
    once = texts.groupBy("doc_id", "_mark").agg(F.any_value("good").alias("good"), F.any_value("text").alias("text"))
    rows = once.mapInArrow(_features, "good boolean, bits binary").collect()
    rows.sort(key=lambda r: (r["good"], bytes(r["bits"])))  # whatever the order of the tasks
    places = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))).astype(np.uint16) for r in rows]
    return train(places, np.array([r["good"] for r in rows], bool), shares.get(True, 0) / total)


def _scores(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(indicators(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    return scores


def classify(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    held_out -- over ``doc_id``; labels of such ids are not learned.  The result
    is written, so that a lost task cannot mix two models.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(given, labels, held_out, per_class)
    kind = dict(given.dtypes)["doc_id"]
    rows = given.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _scores(model), f"doc_id {kind}, held_out boolean, score double"
    )
    return materialize(rows.withColumn("predicted", (F.col("score") >= LIMIT).cast("int")), "quality")
