"""The classifier: held-out accuracy, the dual optimum, defined cases."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import naive_bayes_svm as svm
from linkloom.llm.shared import crc_modulo, documents, table

DOCS = "doc_id long, text string, good int, quality int, _mark int"


def held():
    return crc_modulo(F.col("doc_id"), 5) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = svm.classify(documents(spark, sf), table(spark, sf, "labels"), held())
    judged = rows.filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert len(judged) > 50
    assert np.mean([r.predicted == r.quality for r in judged]) > 0.97
    assert rows.count() == documents(spark, sf).count()


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(80)]
    ratio = rng.normal(0, 1, 12)
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    weights, bias = svm.dual_descent(rows, ratio, y, 1.0, 3000)

    def loss(w, b):
        total = (w @ w + b * b) / 2
        for places, sign in zip(rows, y, strict=True):
            x = ratio[places]
            x = x / max(np.sqrt(x @ x), 1e-300)
            total += max(0.0, 1 - sign * (w[places] @ x + b))
        return total

    best = loss(weights, bias)
    for _ in range(300):
        assert best <= loss(weights + rng.normal(0, 0.02, 12), bias + rng.normal(0, 0.02)) + 2e-3


def test_count_ratio_against_plain_counts():
    rows = [np.array([0, 1]), np.array([1, 2]), np.array([2])]
    got = svm.count_ratio(rows, np.array([True, True, False]))
    p, q = np.ones(svm.BUCKETS), np.ones(svm.BUCKETS)
    p[:3] += [1, 2, 1]
    q[2] += 1
    assert np.allclose(got, np.log(p / p.sum() / (q / q.sum())))


def test_indicators_read_whole_texts():
    short, long = svm.indicators("abc " * 1000), svm.indicators("abc " * 300_000 + "§")
    assert (long & ~short).any()
    assert not svm.indicators(None).any() and not svm.indicators("").any()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_defined_cases(spark):
    rng = random.Random(1)
    good = [(i, words(rng, 40)) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in words(rng, 40).split())) for i in range(100)]
    odd = [(None, "null id"), (3000, None), (3001, ""), (3002, "x" * 2_000_000), (1, words(rng, 30)), (1, good[1][1])]
    docs = spark.createDataFrame([(*r, 9, 9, 9) for r in good + bad + odd], DOCS)
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    labels += [(None, 0), (3000, None), (3001, 5), (4000, 1), (7, 0), (7, 0), (8, 0)]
    labelled = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, text string")
    got = svm.classify(docs.repartition(3), labelled, held()).collect()
    assert len(got) == len(good + bad + odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = [r.predicted == (r.doc_id < 1000) for r in got if r.doc_id is not None and r.doc_id < 3000]
    assert np.mean(right) > 0.97
    verdict = {r.doc_id: r.good for r in svm.verdicts(labelled, F.lit(False)).collect()}
    assert verdict[7] is False and 8 not in verdict and None not in verdict and 3001 not in verdict


def test_no_labels_one_class_or_no_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 1, 1, 1) for i in range(10)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in svm.classify(docs, none, held()).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert {r.predicted for r in svm.classify(docs, one, held()).collect()} == {1}
    assert svm.classify(docs.limit(0), one, held()).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(5, "same text", 1, 1, 1)] * 500 + [(i, f"text {i}", 1, 1, 1) for i in range(10, 300)], DOCS)
    labels = spark.createDataFrame([(5, 1)] + [(i, i % 2) for i in range(10, 300)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(svm, "train", lambda rows, good, share: seen.append(len(rows)) or svm.Model(np.zeros(svm.BUCKETS), np.zeros(svm.BUCKETS), 0.0))
    svm.fit(docs, labels, F.lit(False), per_class=20)
    assert seen == [40]
