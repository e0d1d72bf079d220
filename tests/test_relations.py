import random

import pytest

from linkloom.operators import labels, neighbors, relations
from linkloom.sources import readers
from tests.conftest import ranked, rows

KB1 = [
    '<http://a/p1> <http://a/name> "Ann Lee" .',
    '<http://a/p2> <http://a/name> "Bob" .',
    '<http://a/c1> <http://a/name> "Crete"@en .',
    "<http://a/p1> <http://a/livesIn> <http://a/c1> .",
    "<http://a/p2> <http://a/livesIn> <http://a/c1> .",
    "<http://a/p3> <http://a/livesIn> <http://a/c2> .",
    "<http://a/p1> <http://a/knows> <http://a/p2> .",
    "<http://a/p3> <http://a/knows> <http://a/p2> .",
    "<http://a/p1> <http://a/bornIn> <http://a/c2> .",
]
KB2 = [
    '<http://b/q1> <http://b/label> "ann LEE" .',
    '<http://b/q2> <http://b/label> "bob" .',
    '<http://b/d1> <http://b/label> "Bob!" .',
    '<http://b/d1> <http://b/label> "Crete-en" .',
    "<http://b/q1> <http://b/lives> <http://b/d1> .",
    "<http://b/q2> <http://b/lives> <http://b/d1> .",
]
IDS1 = ["<http://a/p1>\t1", "<http://a/p2>\t2", "<http://a/c1>\t3", "<http://a/c2>\t4", "<http://a/p3>\t5"]
IDS2 = ["<http://b/q1>\t0", "<http://b/q2>\t1", "<http://b/d1>\t2"]


@pytest.fixture(scope="module")
def kb(spark):
    def lines(items):
        return spark.createDataFrame([(i,) for i in items], "value string")

    e1 = readers.parse_entity_ids(lines(IDS1))
    e2 = readers.parse_entity_ids(lines(IDS2), 2)
    return {
        "r1": relations.resolve_triples(readers.parse_relations(lines(KB1)), e1),
        "r2": relations.resolve_triples(readers.parse_relations(lines(KB2)), e2),
        "s1": readers.parse_statements(lines(KB1)),
        "s2": readers.parse_statements(lines(KB2)),
        "e1": e1,
        "e2": e2,
    }


def out(kb, side, n=2, **kw):
    index = relations.relation_index(kb[f"r{side}"])
    return relations.top_out_neighbors(index, relations.relation_stats(index), n, **kw)


def test_relation_stats(kb):
    index = relations.relation_index(kb["r1"])
    got = {r.p: (r.support, r.discriminability, r.score) for r in relations.relation_stats(index).collect()}
    assert got.keys() == {"<http://a/livesin>", "<http://a/knows>", "<http://a/bornin>"}
    assert got["<http://a/livesin>"] == pytest.approx((1, 2 / 3, 0.8))
    assert got["<http://a/knows>"] == pytest.approx((2 / 3, 0.5, 0.571429), abs=1e-6)
    assert got["<http://a/bornin>"] == pytest.approx((1 / 3, 1, 0.5))
    ranks = relations.relation_rank(relations.relation_stats(index))
    assert [r.p[10:-1] for r in ranks.orderBy("rank").collect()] == ["livesin", "knows", "bornin"]
    second = relations.relation_stats(relations.relation_index(kb["r2"])).collect()
    assert [(r.p, round(r.score, 6)) for r in second] == [("<http://b/lives>", 0.666667)]


def test_out_and_in_neighbors(kb):
    assert rows(out(kb, 1)) == [(1, 2), (1, 3), (2, 3), (5, 2), (5, 4)]
    assert rows(out(kb, 2)) == [(-2, -3), (-1, -3)]
    assert rows(relations.in_neighbors(out(kb, 1))) == [(2, 1), (2, 5), (3, 1), (3, 2), (4, 5)]
    assert rows(out(kb, 1, n=1)) == [(1, 3), (2, 3), (5, 4)]


def test_low_support_relations(kb):
    # only livesin passes; the others either vanish or come first
    assert rows(out(kb, 1, n=1, min_support=0.9)) == [(1, 3), (2, 3), (5, 4)]
    assert rows(out(kb, 1, n=1, min_support=0.9, keep_low_support=True)) == [(1, 2), (1, 4), (2, 3), (5, 2)]


def test_label_attributes(kb):
    resolved = relations.resolve_triples(kb["s1"], kb["e1"])
    got = [(r.p, r.support, r.discriminability, r["rank"]) for r in relations.label_attributes(resolved).collect()]
    assert got == [("<http://a/name>", 1.0, 1.0, 1)]


def test_label_matches(spark, kb):
    l1 = labels.label_blocks(kb["s1"], kb["e1"], ["<http://a/Name>"])
    l2 = labels.label_blocks(kb["s2"], kb["e2"], ["<http://b/label>"])
    assert rows(l2) == [("ann lee", -1), ("bob", -3), ("bob", -2), ("creteen", -3)]
    assert rows(labels.label_matches(l1, l2)) == [(-3, 3), (-1, 1)]


def test_two_partners_give_no_label_match(spark):
    schema = "label string, entity_id bigint"
    l1 = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], schema)
    l2 = spark.createDataFrame([("x", -1), ("y", -1), ("z", -2)], schema)
    assert rows(labels.label_matches(l1, l2)) == [(-2, 3)]
    # one collection-1 entity may serve two of collection 2
    l2 = spark.createDataFrame([("x", -1), ("w", -2)], schema)
    l1 = spark.createDataFrame([("x", 1), ("w", 1)], schema)
    assert rows(labels.label_matches(l1, l2)) == [(-2, 1), (-1, 1)]


def test_empty_labels(kb, spark):
    triples = spark.createDataFrame([("<http://a/p1>", "n", '"!"')], "s string, p string, o string")
    assert rows(labels.label_blocks(triples, kb["e1"], ["n"])) == [("", 1)]
    assert rows(labels.label_blocks(triples, kb["e1"], ["n"], drop_empty=True)) == []


@pytest.mark.parametrize("effort", [1000, 0])
@pytest.mark.parametrize(
    "combine,expected",
    [
        ("sum", {(-1, 1): 3.25, (-2, 1): 3.25, (-1, 2): 3.0, (-2, 2): 3.0, (-1, 5): 0.25, (-2, 5): 0.25}),
        ("max", {(-1, 1): 1.5, (-2, 1): 1.5, (-1, 2): 1.5, (-2, 2): 1.5, (-1, 5): 0.25, (-2, 5): 0.25}),
    ],
)
def test_neighbor_similarity(spark, kb, combine, expected, effort):
    values = ranked(spark, {-3: [(3, 1.5)], 3: [(-3, 1.5)], 2: [(-3, 0.25)]})
    near = relations.merge_in_neighbors(
        relations.in_neighbors(out(kb, 1)), relations.in_neighbors(out(kb, 2))
    )
    got = neighbors.top_neighbor_candidates(values, near, 10, combine, effort=effort)
    found = {(r.entity_id, r.cand_id): r.score for r in got.collect()}
    both = {**expected, **{(b, a): s for (a, b), s in expected.items()}}
    assert found == both
    expanded = {}
    for r in neighbors.neighbor_pairs(values, near).collect():
        expanded.setdefault((r.entity_id, r.cand_id), []).append(r.sim)
    fold = max if combine == "max" else sum
    assert {k: fold(v) for k, v in expanded.items()} == both


def test_neighbor_combine_is_checked(spark, kb):
    with pytest.raises(ValueError):
        neighbors.top_neighbor_candidates(ranked(spark, {1: [(-1, 1)]}), relations.in_neighbors(out(kb, 1)), 1, "avg")


def plain_out_neighbors(index, standing, n):
    best = {}
    for p, s, o in index:
        if p in standing:
            key = (-standing[p], p)
            best[s, o] = min(best.get((s, o), key), key)
    keys = {}
    for (s, _), k in best.items():
        keys.setdefault(s, set()).add(k)
    kept = {s: sorted(found)[:n] for s, found in keys.items()}
    return sorted((s, o) for (s, o), k in best.items() if k in kept[s])


def test_out_neighbors_of_a_hub(spark):
    rng = random.Random(5)
    # Subject 0 has very many objects; all of those of "shadow" also come by the better "main".
    index = [("main", 0, o) for o in range(20_000)] + [("shadow", 0, o) for o in range(5_000)]
    index += [("rare", 0, 30_000 + o) for o in range(3)] + [("low", 0, 40_000)]
    index += [(rng.choice(["main", "rare", "shadow", "low"]), rng.randint(1, 40), rng.randrange(30)) for _ in range(300)]
    standing = {"main": 0.9, "shadow": 0.8, "rare": 0.8, "low": 0.1}
    stats = spark.createDataFrame([(p, 0.5, 1.0, v) for p, v in standing.items()], "p string, support double, discriminability double, score double")
    rows_in = spark.createDataFrame(index, "p string, s_id bigint, o_id bigint")
    for n in (1, 2, 3):
        assert rows(relations.top_out_neighbors(rows_in, stats, n)) == plain_out_neighbors(index, standing, n)


def test_hot_predicates_and_objects_are_not_sorted(kb):
    """A predicate or an object that most triples have does not gather its triples in one task."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Sort [o#" not in plan(kb["r1"])
    index = relations.relation_index(kb["r1"])
    assert "hashpartitioning(p#" not in plan(index)
    stats = relations.relation_stats(index)
    assert "hashpartitioning(p#" not in plan(relations.top_out_neighbors(index, stats, 2))
    assert rows(index.select("p").distinct()) == rows(stats.select("p"))
