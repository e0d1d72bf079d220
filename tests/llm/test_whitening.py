"""Whitening against plain whole-number arithmetic and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from linkloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string, i int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 7, "x", 1) for k, v in rows], SCHEMA)


def plain(rows):
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, size = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(size)]
    deviation = [sum((n * r[d] - sums[d]) ** 2 for d in range(size)) for r in x]
    cov = np.array([[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n**3 for j in range(size)] for i in range(size)])
    return kept, x, sums, deviation, cov


@pytest.mark.parametrize("wide", [0.5, 3000.0])
def test_equals_plain_arithmetic(spark, wide):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, wide, 5) * [1, 2, 3, 4, 5]]) for i in range(150)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (900, None), (901, [1.0, None, 2.0, 3.0, 4.0])]
    rows += [(902, [float("nan")] * 5), (903, [1.0, float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    usable = [(k, v) for k, v in rows if v and len(v) == 5]
    kept, x, sums, deviation, cov = plain(usable)
    got = whitening.by_component(whitening.whiten(table(spark, rows).repartition(4))).collect()
    assert len(got) == 5 * len(kept)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    centred = np.array(x) - np.array(sums) / len(x)
    for (k, _), d, w in zip(kept, deviation, (centred @ vectors) / np.sqrt(values), strict=True):
        want.setdefault(k, (d, w))
    sign = {}
    for row in got:
        d, w = want[row.vec_id]
        assert row.n == len(kept) and row.deviation == d
        c = row.component - 1
        assert abs(abs(row.whitened) - abs(w[c])) < 1e-7
        if abs(w[c]) > 1e-3:
            assert sign.setdefault(c, np.sign(row.whitened * w[c])) == np.sign(row.whitened * w[c])
        assert abs(row.explained / (values[c] / values.sum()) - 1) < 1e-9
        assert row.identity_error < 1e-9


def test_sliced_products_are_exact():
    rng = np.random.default_rng(5)
    for rows, largest in ((1, 2), (63, 9), (64, 1), (65, 1 << 20), (200, 1 << 41)):
        values = rng.integers(0, largest, (rows, 4))
        got = whitening.sliced_products(values)
        for i in range(4):
            for j in range(i, 4):
                assert got[i][j] == sum(int(a) * int(b) for a, b in zip(values[:, i], values[:, j], strict=True))


def test_blocks_add_up(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3)]) for i in range(500)]
    whole = whitening.fit(table(spark, rows).repartition(1))
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 300)
    parts = whitening.fit(table(spark, rows).repartition(7))
    assert (parts.n, parts.sums) == (whole.n, whole.sums)
    assert np.array_equal(parts.values, whole.values) and np.array_equal(parts.vectors, whole.vectors)


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(2, 10**7, [5 * 10**7 + 3, -(10**15)], None, None, 0.0)
    values = np.array([[1 << 30, -(1 << 33)], [0, 7]])
    want = [sum((10**7 * int(v) - s) ** 2 for v, s in zip(r, model.sums, strict=True)) for r in values]
    assert whitening.deviations(model, values) == want


def test_degenerate_tables(spark):
    assert whitening.by_component(whitening.whiten(table(spark, []))).count() == 0
    assert whitening.by_component(whitening.whiten(table(spark, [(1, None), (2, [])]))).count() == 0
    assert whitening.by_component(whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).count() == 0
    # a constant and a repeated dimension: one component is left
    rows = [(i, [float(i), float(i), 3.0]) for i in range(10)]
    got = whitening.by_component(whitening.whiten(table(spark, rows))).collect()
    assert {r.component for r in got} == {1} and len(got) == 10
    assert abs(sum(r.whitened**2 for r in got) / 10 - 1) < 1e-9


def test_very_long_vectors_and_at_most_32_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 200)]) for i in range(60)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {len(r.whitened) for r in got} == {32} and got[0].identity_error < 1e-9
