import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import evaluation, matching, rank_aggregation as borda
from tests.conftest import pairs, ranked, rows

VALUES = {-1: [(1, 0.9), (2, 0.5)], -2: [(2, 1.2)], -3: [(3, 0.4)], 1: [(-1, 0.9)], 2: [(-2, 1.2), (-1, 0.5)]}
NEIGHBORS = {-1: [(2, 3.0)], 1: [(-1, 3.0)], 3: [(-3, 1.0)]}


def test_reciprocal_matching(spark):
    values, near = ranked(spark, VALUES), ranked(spark, NEIGHBORS)
    sure = matching.top1_value_matches(values)
    assert rows(sure) == [(-2, 2)]
    edges = matching.candidate_edges(matching.rank_scores(values, near, sure, 0.6))
    summed = {(r.d2_id, r.d1_id): r.weight / 1e12 for r in matching.joined_edges(edges).collect()}
    assert summed == pytest.approx({(-1, 1): 1.6, (-1, 2): 1.0, (-2, 2): 0.6, (-3, 3): 1.0})
    best = matching.best_candidate(matching.joined_edges(edges), sure)
    assert rows(best.select("d2_id", "d1_id")) == [(-3, 3), (-1, 1)]
    assert rows(matching.reciprocal_matches(values, near, 0.6)) == [(-3, 3), (-2, 2), (-1, 1)]


def test_best_candidate_must_be_reciprocal(spark):
    values = ranked(spark, {-1: [(1, 0.9), (2, 0.5)], 2: [(-1, 0.5)]})
    near = ranked(spark, {-1: [(1, 1.0)]})
    # (-1, 1) scores best but entity 1 does not suggest it
    assert rows(matching.reciprocal_matches(values, near)) == []


def test_mutual_top1_and_override(spark):
    top1 = spark.createDataFrame([(-1, 4), (4, -1), (-2, 4), (5, -2)], "entity_id bigint, cand_id bigint")
    assert rows(matching.mutual_top1(top1)) == [(-1, 4)]
    assert rows(matching.override(pairs(spark, [(-1, 4), (-2, 5)]), pairs(spark, [(-2, 6), (-3, 7)]))) == [
        (-3, 7), (-2, 6), (-1, 4),
    ]


def lists(spark, values, near):
    as_ranked = lambda l: ranked(spark, {e: [(c, 1.0) for c in cs] for e, cs in l.items()})
    return as_ranked(values), as_ranked(near)


def test_borda_common_candidate(spark):
    v, n = lists(spark, {1: [10, 11, 12]}, {1: [12, 13]})
    got = {r.cand_id: (r.score, r.source) for r in borda.borda_provenance(v, n, 9).collect()}
    assert got == {10: (3, "VALUES"), 11: (2, "VALUES"), 12: (4, "BOTH"), 13: (2, "NEIGHBORS")}
    assert rows(borda.borda_top1(v, n)) == [(1, 12, 4)]
    top2 = borda.borda_topk(v, n, 2).orderBy("rank").collect()
    assert [r.cand_id for r in top2] == [12, 10]


def test_borda_longer_neighbor_list(spark):
    v, n = lists(spark, {1: [10]}, {1: [11, 12, 10]})
    assert rows(borda.borda_top1(v, n)) == [(1, 10, 4)]
    got = {r.cand_id: r.score for r in borda.borda_topk(v, n, 3).collect()}
    assert got == {10: 2, 11: 3, 12: 2}


def reference_top1(v, n):
    """Plain restatement of the top-1 rule for one entity."""
    if not v or not n:
        return (v or n)[0]
    longest = max(len(v), len(n))
    long, short = (v, n) if len(v) >= len(n) else (n, v)
    best, best_score = v[0], longest
    for c in long + [c for c in short if c not in long]:
        score = sum(longest - l.index(c) for l in (v, n) if c in l)
        if score > best_score:
            best, best_score = c, score
    return best


def test_borda_top1_rule_on_random_lists(spark):
    rng = random.Random(5)
    values, near = {}, {}
    for e in range(60):
        pool = list(range(-9, -1))
        if rng.random() < 0.9:
            values[e] = rng.sample(pool, rng.randint(1, 5))
        if rng.random() < 0.9 or e not in values:
            near[e] = rng.sample(pool, rng.randint(1, 5))
    v, n = lists(spark, values, near)
    got = {r.entity_id: r.cand_id for r in borda.borda_top1(v, n).collect()}
    assert got == {e: reference_top1(values.get(e, []), near.get(e, [])) for e in values.keys() | near.keys()}


def test_borda_single_lists_and_counts(spark):
    v, n = lists(spark, {1: [10, 11], 3: [5]}, {2: [12, 13, 14], 3: [5, 6]})
    agg = borda.borda_provenance(v, n, 2)
    assert rows(agg.drop("has_common")) == [
        (1, 10, 2, 1, "VALUES_WITH_EMPTY_NEIGHBORS"),
        (1, 11, 1, 2, "VALUES_WITH_EMPTY_NEIGHBORS"),
        (2, 12, 2, 1, "NEIGHBORS_WITH_EMPTY_VALUES"),
        (2, 13, 1, 2, "NEIGHBORS_WITH_EMPTY_VALUES"),
        (3, 5, 3, 1, "BOTH"),
        (3, 6, 1, 2, "NEIGHBORS"),
    ]
    assert dict(rows(borda.provenance_counts(agg))) == {
        "VALUES_WITH_EMPTY_NEIGHBORS": 2, "NEIGHBORS_WITH_EMPTY_VALUES": 2, "BOTH": 1, "NEIGHBORS": 1,
    }
    assert rows(borda.lists_with_common(agg)) == [(3, 1)]


def quality(df):
    r = df.first()
    return (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1)


def test_match_evaluation(spark):
    found, truth = pairs(spark, [(-1, 1), (-2, 3), (-4, 9)]), pairs(spark, [(-1, 1), (-2, 2), (-3, 3)])
    third = pytest.approx(1 / 3)
    assert quality(evaluation.evaluate_matches(found, truth)) == (1, 2, 2, third, third, third)
    assert quality(evaluation.evaluate_matches(found, truth, truth_only=True)) == (1, 1, 2, 0.5, third, pytest.approx(0.4))
    nothing = evaluation.evaluate_matches(found.where("false"), truth)
    assert quality(nothing) == (0, 0, 3, None, 0.0, None)


def test_candidate_evaluation(spark):
    cands = pairs(spark, [(-1, 1), (-1, 5), (-2, 3), (-2, 4), (-4, 9)])
    truth = pairs(spark, [(-1, 1), (-2, 2), (-3, 3)])
    assert quality(evaluation.evaluate_candidates(cands, truth))[:3] == (1, 4, 2)
    assert quality(evaluation.evaluate_candidates(cands, truth, truth_only=True))[:3] == (1, 3, 2)
    assert rows(evaluation.true_positive_ids(cands, truth)) == [(-1,)]
    assert rows(evaluation.missed_matches(cands, truth)) == [(-3, 3, 0), (-2, 2, 2)]
    sourced = cands.withColumn("source", F.lit("BOTH"))
    assert rows(evaluation.true_positives_by_source(sourced, truth)) == [("BOTH", 1)]


def test_symmetric_lists_sides_and_contributions(spark):
    cands = ranked(spark, {-1: [(0, 1.0)], 0: [(-1, 1.0)], 3: [(-1, 1.0)], -2: [(5, 1.0)]})
    assert rows(evaluation.symmetric_candidates(cands)) == [(-2, 5), (-1, 0), (-1, 3)]
    truth = pairs(spark, [(-1, 3), (-2, 5)])
    sides = {r.side: (r.tp, r.fp, r.fn) for r in evaluation.evaluate_sides(cands, truth).collect()}
    assert sides == {2: (1, 1, 1), 1: (1, 1, 1)}
    values, near = pairs(spark, [(-1, 3), (-2, 9)]), pairs(spark, [(-1, 3), (-2, 5)])
    got = evaluation.contributions(values, near, truth).first()
    assert tuple(got) == (1, 2, 2, 1, 1.0)


def test_quality_by_source(spark):
    cands = spark.createDataFrame(
        [(-1, 1, "BOTH"), (-1, 5, "VALUES"), (-2, 3, "VALUES"), (-4, 9, "NEIGHBORS"), (-5, 2, "VALUES"), (-5, 3, "BOTH")],
        "d2_id bigint, d1_id bigint, source string",
    )
    truth = pairs(spark, [(-1, 1), (-2, 2), (-3, 3), (-5, 2)])
    got = {r.source: tuple(r)[1:] for r in evaluation.evaluate_by_source(cands, truth).collect()}
    totals = (2, 4, 2, pytest.approx(1 / 3), 0.5, pytest.approx(0.4))
    assert got == {
        s: (n, *totals)
        for s, n in [
            ("VALUES", 1), ("BOTH", 1), ("NEIGHBORS", 0),
            ("VALUES_WITH_EMPTY_NEIGHBORS", 0), ("NEIGHBORS_WITH_EMPTY_VALUES", 0),
        ]
    }
    assert quality(evaluation.evaluate_candidates(cands, truth)) == totals
    nothing = evaluation.evaluate_by_source(cands.where("false"), truth).collect()
    assert {tuple(r)[1:5] for r in nothing} == {(0, 0, 0, 4)} and len(nothing) == 5


def test_a_very_long_candidate_list(spark):
    long = spark.range(1_000_000).selectExpr("-7L AS d2_id", "id AS d1_id")
    cands = long.unionByName(pairs(spark, [(-1, 1), (-2, 4)]))
    truth = pairs(spark, [(-7, 999_999), (-1, 1), (-2, 3)])
    assert quality(evaluation.evaluate_candidates(cands, truth))[:3] == (2, 1_000_000, 1)
    assert rows(evaluation.missed_matches(cands, truth)) == [(-2, 3, 1)]


def test_candidate_evaluation_against_a_plain_one(spark):
    rng = random.Random(8)
    lists = {-e: set(rng.sample(range(20), rng.randint(0, 6))) for e in range(1, 60)}
    correct = {-e: rng.randrange(20) for e in range(30, 90)}
    cands = pairs(spark, [(e, c) for e, l in lists.items() for c in l])
    truth = pairs(spark, list(correct.items()))
    hit = {e for e, c in correct.items() if c in lists.get(e, ())}
    for only in (False, True):
        judged = sum(len(l) for e, l in lists.items() if e in correct or not only)
        got = quality(evaluation.evaluate_candidates(cands, truth, truth_only=only))[:3]
        assert got == (len(hit), judged - len(hit), len(correct) - len(hit))
    assert rows(evaluation.missed_matches(cands, truth)) == sorted(
        (e, c, len(lists.get(e, ()))) for e, c in correct.items() if e not in hit
    )
