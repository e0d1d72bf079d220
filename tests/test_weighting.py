import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from linkloom.operators import blocking, evaluation, shared_top_k, weighting
from linkloom.operators.shared_top_k import grid_join, link_posts, top_partners
from linkloom.sources import readers
from tests.conftest import pairs as pair_frame
from tests.conftest import rows


@pytest.fixture(scope="module")
def fixture_blocks(block_lines):
    index = blocking.block_filtering(readers.parse_blocks(block_lines)).cache()
    return index, blocking.rebuild_blocks(index).cache()


EXPECTED = {
    "cbs": {(-5, 3): 1, (-5, 4): 1, (-5, 5): 2, (-4, 1): 1, (-1, 1): 1, (-1, 3): 2, (-1, 5): 1},
    "arcs": {
        (-5, 3): 0.356207, (-5, 5): 1.356207, (-4, 1): 0.244651, (-4, 3): 0.244651,
        (-1, 1): 0.244651, (-1, 3): 0.600858, (-1, 5): 0.356207,
    },
    "idf": {
        (-5, 3): 0.619789, (-5, 5): 2.017729, (-4, 1): 0.19382, (-4, 3): 0.19382,
        (-1, 1): 0.19382, (-1, 3): 0.813609, (-1, 5): 0.619789,
    },
    "wjs": {
        (-5, 3): 0.437807, (-5, 5): 1.0, (-4, 1): 1.0, (-4, 3): 0.466285,
        (-1, 1): 0.327531, (-1, 3): 1.0, (-1, 5): 0.437807,
    },
}


@pytest.mark.parametrize("scheme", weighting.SCHEMES)
@pytest.mark.parametrize("effort", [1000, 0])
def test_pair_weights(fixture_blocks, scheme, effort):
    index, sized = fixture_blocks
    got = weighting.top_candidates(sized, 10, scheme, entity_index=index, effort=effort)
    weights = {(r.entity_id, r.cand_id): round(r.score, 6) for r in got.collect()}
    for (d2, d1), weight in EXPECTED[scheme].items():
        assert weights[d2, d1] == weights[d1, d2] == pytest.approx(weight, abs=2e-6)
    assert len(weights) == 2 * 20


def test_entity_weights(fixture_blocks):
    index, sized = fixture_blocks
    got = {r.entity_id: round(float(r.norm) / 1e12, 6) for r in weighting.entity_weights(sized, index).collect()}
    assert got == {
        -5: 1.09691, -4: 0.09691, -3: 0.09691, -2: 0.09691, -1: 0.49485,
        1: 0.09691, 2: 0.09691, 3: 0.318759, 4: 0.318759, 5: 0.920819,
    }


@pytest.mark.parametrize("effort", [1000, 0])
def test_arcs_top1(fixture_blocks, effort):
    index, sized = fixture_blocks
    top = weighting.top_candidates(sized, 1, "arcs", effort=effort)
    assert {r.entity_id: r.cand_id for r in top.collect()} == {
        -5: 5, -4: 1, -3: 1, -2: 1, -1: 3, 1: -4, 2: -4, 3: -1, 4: -1, 5: -5,
    }


def random_blocks(seed, n=24):
    """Blocks with one hot block, groups of identical entities and loners."""
    rng = random.Random(seed)
    members = set()
    entities = list(range(n)) + [-(i + 1) for i in range(n)]
    for e in entities:
        style = rng.random()
        if style < 0.7:
            members.add((0, e))
        for block in range(1, 5):
            if rng.random() < 0.4:
                members.add((block, e))
        for block in range(5, 25):
            if rng.random() < 0.06:
                members.add((block, e))
    return sorted(members)


def brute_top_k(members, scheme, k):
    blocks = {}
    for b, e in members:
        blocks.setdefault(b, set()).add(e)
    sides = {b: (sum(e >= 0 for e in es), sum(e < 0 for e in es)) for b, es in blocks.items()}
    blocks = {b: es for b, es in blocks.items() if min(sides[b]) > 0}
    entities = {e for es in blocks.values() for e in es}
    n1, n2 = sum(e >= 0 for e in entities), sum(e < 0 for e in entities)
    fixed = lambda x: round(x * 10**12)
    norm = {e: 0 for e in entities}
    score = {}
    for b, es in blocks.items():
        s1, s2 = sides[b]
        i1, i2 = fixed(math.log10(n1 / s1)), fixed(math.log10(n2 / s2))
        w = {"cbs": 10**12, "arcs": fixed(1 / math.log2(1 + s1 * s2)), "idf": i1 + i2, "wjs": i1 + i2}[scheme]
        for e in es:
            norm[e] += i1 if e >= 0 else i2
        for a in es:
            for c in es:
                if (a < 0) != (c < 0):
                    score[a, c] = score.get((a, c), 0) + w
    lists = {}
    for (a, c), s in score.items():
        if scheme == "wjs":
            v = s / (norm[a] + norm[c]) if norm[a] + norm[c] else 0.0
        else:
            v = ((s + 500) // 1000) / 1e9
        lists.setdefault(a, []).append((-v, c))
    return {(a, c): (rank, -v) for a, l in lists.items() for rank, (v, c) in enumerate(sorted(l)[:k], 1)}


@pytest.mark.parametrize(
    "scheme,seed,effort,probes,k",
    [
        ("cbs", 1, 0, 1, 3), ("arcs", 3, 0, 2, 5), ("idf", 4, 0, 1, 2), ("wjs", 5, 0, 1, 3), ("arcs", 7, 5, 1, 2),
        ("wjs", 8, 1000, 8, 1),
    ],
)
def test_hot_blocks_match_brute_force(spark, scheme, seed, effort, probes, k):
    members = random_blocks(seed)
    df = spark.createDataFrame(members, "block_id bigint, entity_id bigint")
    sized = blocking.with_sizes(df)
    got = weighting.top_candidates(sized, k, scheme, effort=effort, probes=probes)
    got = {(r.entity_id, r.cand_id): (r["rank"], r.score) for r in got.collect()}
    want = brute_top_k(members, scheme, k)
    assert got.keys() == want.keys()
    for key, (rank, score) in want.items():
        assert got[key][0] == rank
        assert got[key][1] == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize("combine", ["sum", "max"])
@pytest.mark.parametrize("seed,effort", [(5, 3), (6, 0)])
def test_links_between_different_features(spark, combine, seed, effort):
    rng = random.Random(seed)
    left = sorted({(e, rng.choice([100, 100, 101, 102, 103, 104])) for e in range(20) for _ in range(2)})
    right = sorted({(-(e + 1), rng.choice([-100, -100, -101, -102, -103])) for e in range(20) for _ in range(2)})
    deg = {}
    for _, f in left + right:
        deg[f] = deg.get(f, 0) + 1
    links = [
        (f1, f2, rng.randint(1, 5) * 10**12, deg[f1], deg[f2])
        for f1 in range(100, 105) for f2 in range(-103, -99)
        if rng.random() < 0.5 and f1 in deg and f2 in deg
    ]
    k = 2
    score = {}
    for f1, f2, w, _, _ in links:
        for a, fa in left:
            for b, fb in right:
                if fa == f1 and fb == f2:
                    for key in ((a, b), (b, a)):
                        old = score.get(key, 0)
                        score[key] = max(old, w) if combine == "max" else old + w
    lists = {}
    for (a, b), s in score.items():
        lists.setdefault(a, []).append((-s / 1e12, b))
    want = {(a, b, -s, r) for a, l in lists.items() for r, (s, b) in enumerate(sorted(l)[:k], 1)}
    posts = link_posts(
        spark.createDataFrame(left, "entity_id bigint, feature bigint"),
        spark.createDataFrame(right, "entity_id bigint, feature bigint"),
        spark.createDataFrame(links, "f1 bigint, f2 bigint, weight bigint, n1 bigint, n2 bigint"),
    )
    got = top_partners(posts, k, combine=combine, effort=effort, probes=1)
    assert {(r.entity_id, r.cand_id, r.score, r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("seed,cell", [(7, 1000), (8, 2)])
def test_raw_block_evaluation(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(shared_top_k, "CELL", cell)
    members = random_blocks(seed)
    df = spark.createDataFrame(members, "block_id bigint, entity_id bigint")
    truth_rows = [(-(i + 1), i) for i in range(24)]
    by_entity = {}
    for b, e in members:
        by_entity.setdefault(e, set()).add(b)
    met = {
        (a, c)
        for a in by_entity for c in by_entity
        if a < 0 <= c and by_entity[a] & by_entity[c]
    }
    tp = sum(p in met for p in truth_rows)
    got = evaluation.evaluate_blocks(df, pair_frame(spark, truth_rows)).first()
    assert (got.tp, got.fp, got.fn) == (tp, len(met) - tp, len(truth_rows) - tp)
    plain = evaluation.evaluate_candidates(pair_frame(spark, sorted(met)), pair_frame(spark, truth_rows)).first()
    assert (plain.tp, plain.fp, plain.fn) == (got.tp, got.fp, got.fn)


def test_totals_beyond_64_bits(spark):
    """Scores of 1e8, as sums of many neighbours give them."""
    posts = [(e, b, 4 * 10**19, 2, 2) for e in (1, 2, -1, -2) for b in range(3)] + [(5, 9, 10**12, 1, 1), (-5, 9, 10**12, 1, 1)]
    df = spark.createDataFrame([(e, b, Decimal(w), n1, n2) for e, b, w, n1, n2 in posts],
                               "entity_id bigint, link bigint, weight decimal(38,0), n1 bigint, n2 bigint")
    for effort in (0, 1000):
        got = {(r.entity_id, r.cand_id): r.score for r in top_partners(df, 2, effort=effort, probes=1).collect()}
        assert got == {(a, b): 1.2e8 for a, b in [(1, -1), (1, -2), (2, -1), (2, -2), (-1, 1), (-2, 1), (-1, 2), (-2, 2)]} | {(5, -5): 1.0, (-5, 5): 1.0}


def test_one_hot_link_spreads(spark):
    """A link of 100,000 entities with one partner, and the tail of a giant block."""
    n = 100_000
    posts = spark.range(n).selectExpr("id as entity_id", "7L as link", "cast(1000000000000 as decimal(38,0)) as weight", f"{n}L as n1", "1L as n2")
    posts = posts.unionByName(spark.sql(f"select -1L as entity_id, 7L as link, cast(1000000000000 as decimal(38,0)) as weight, {n}L as n1, 1L as n2"))
    got = top_partners(posts, 3)
    assert [(r.cand_id, r["rank"]) for r in got.where("entity_id = -1").orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert got.count() == n + 3
    cells = grid_join(posts.where("entity_id >= 0"), posts.where("entity_id < 0"))
    assert cells.count() == n


def test_invariants(fixture_blocks):
    index, sized = fixture_blocks
    for scheme in weighting.SCHEMES:
        top = weighting.top_candidates(sized, 2, scheme, entity_index=index)
        assert top.where((F.col("entity_id") < 0) == (F.col("cand_id") < 0)).count() == 0
        assert top.where("rank > 2").count() == 0
    assert rows(weighting.top_candidates(sized, 9, "wjs", entity_index=index).where("score > 1")) == []


def test_unknown_scheme(fixture_blocks):
    with pytest.raises(ValueError):
        weighting.top_candidates(fixture_blocks[1], 1, "bm25")
