"""Lists and counts that are found without a row for each pair and link."""

import random

import pytest

from linkloom.operators import blocking, evaluation, neighbors, shared_top_k, tiles, weighting
from linkloom.operators.shared_top_k import top_partners
from tests.conftest import pairs as pair_frame
from tests.test_weighting import brute_top_k, random_blocks


def few_blocks(seed, n=30):
    """At most four blocks of each entity, some of them hot, many entities alike."""
    rng = random.Random(seed)
    entities = list(range(n)) + [-(i + 1) for i in range(n)]
    return sorted({(b, e) for e in entities for b in rng.sample([0, 0, 1, 1, 2, 3, 4, 5, 6, 7], rng.randint(1, 4))})


@pytest.fixture
def no_pairs(monkeypatch):
    """No row for a pair and link may be formed."""

    def formed(*_):
        raise AssertionError("pairs were formed")

    monkeypatch.setattr(shared_top_k, "grid_join", formed)


def check_lists(spark, members, scheme, k, **options):
    df = spark.createDataFrame(members, "block_id bigint, entity_id bigint")
    got = weighting.top_candidates(blocking.with_sizes(df), k, scheme, **options)
    got = {(r.entity_id, r.cand_id): (r["rank"], r.score) for r in got.collect()}
    want = brute_top_k(members, scheme, k)
    assert got.keys() == want.keys()
    for key, (rank, score) in want.items():
        assert got[key] == (rank, pytest.approx(score, abs=1e-9))


@pytest.mark.parametrize("scheme,seed,k", [("cbs", 1, 3), ("arcs", 2, 2), ("idf", 3, 5), ("wjs", 4, 3), ("wjs", 5, 1)])
def test_few_links(spark, no_pairs, scheme, seed, k):
    check_lists(spark, few_blocks(seed), scheme, k)


@pytest.mark.parametrize("scheme,columns", [("cbs", 7), ("arcs", 100), ("idf", 7), ("wjs", 7)])
def test_tiles(spark, no_pairs, monkeypatch, scheme, columns):
    monkeypatch.setattr(tiles, "ROWS", 5)
    monkeypatch.setattr(tiles, "COLUMNS", columns)
    check_lists(spark, random_blocks(9), scheme, 3)


@pytest.mark.parametrize("with_norms", [False, True])
@pytest.mark.parametrize("columns", [2, 100])
def test_tiles_of_heavy_entities(spark, no_pairs, monkeypatch, with_norms, columns):
    """Sums beyond the whole numbers that doubles hold are added up in tiles as well, and exactly."""
    monkeypatch.setattr(tiles, "COLUMNS", columns)
    rng = random.Random(5)
    weights = [8 * 10**15 + rng.randrange(10**6) for _ in range(40)]
    entities = [*range(1, 9), *range(-8, 0)]
    held = {e: rng.sample(range(40), 25) for e in entities}
    held[2], held[-2] = held[1], held[-1]  # equal scores
    posts = [(e, b, weights[b], 8, 8) for e in entities for b in held[e]]
    df = spark.createDataFrame(posts, "entity_id bigint, link bigint, weight bigint, n1 bigint, n2 bigint")
    norm = {e: sum(weights[b] for b in held[e]) for e in entities}
    norms = spark.createDataFrame(list(norm.items()), "entity_id bigint, norm bigint") if with_norms else None
    want = set()
    for e in entities:
        lists = []
        for c in entities:
            if (e > 0) != (c > 0):
                total = sum(weights[b] for b in set(held[e]) & set(held[c]))
                score = float(total) / float(norm[e] + norm[c]) if with_norms else float((total + 500) // 1000 * 1000) / 1e12
                lists.append((-score, c))
        want |= {(e, c, -s, n) for n, (s, c) in enumerate(sorted(lists)[:3], 1)}
    got = top_partners(df, 3, norms=norms).collect()
    assert {(r.entity_id, r.cand_id, r.score, r["rank"]) for r in got} == want


@pytest.mark.parametrize("scheme,effort", [("arcs", 0), ("wjs", 0), ("idf", 1000)])
def test_pairs_of_sparse_tables(spark, monkeypatch, scheme, effort):
    monkeypatch.setattr(shared_top_k, "FEW", 0)
    monkeypatch.setattr(shared_top_k, "DENSE", 0)
    check_lists(spark, random_blocks(11), scheme, 3, effort=effort, probes=1)


@pytest.mark.parametrize("weight", [0, 2])
@pytest.mark.parametrize("links", [2, 6])
def test_shared_links_without_weight(spark, no_pairs, weight, links):
    """A pair that shares links is listed, also with a score of 0; ties go to the smaller id, not norm."""
    posts = [(e, b, weight * 10**12, 3, 3) for e in (1, 2, 3, -1, -2, -3) for b in range(links)]
    posts += [(9, 99, 10**12, 1, 0)]
    df = spark.createDataFrame(posts, "entity_id bigint, link bigint, weight bigint, n1 bigint, n2 bigint")
    norms = spark.createDataFrame([(e, (4 - abs(e)) * 10**12) for e in (1, 2, 3, 9, -1, -2, -3)], "entity_id bigint, norm bigint")
    plain = {(r.entity_id, r.cand_id, r.score) for r in top_partners(df, 2).collect()}
    total = float(weight * links)
    assert plain == {(e, c, total) for e in (1, 2, 3) for c in (-3, -2)} | {(e, c, total) for e in (-1, -2, -3) for c in (1, 2)}
    normed = {(r.entity_id, r.cand_id) for r in top_partners(df, 2, norms=norms).collect()}
    firsts = (1, 2) if weight == 0 else (2, 3)
    assert normed == {(e, c) for e in (1, 2, 3) for c in (-3, -2)} | {(e, c) for e in (-1, -2, -3) for c in firsts}


def test_repeated_posts_count_each_time(spark):
    posts = [(1, 7, 10**12, 2, 1), (1, 7, 10**12, 2, 1), (2, 7, 10**12, 2, 1), (-1, 7, 10**12, 2, 1)]
    df = spark.createDataFrame(posts, "entity_id bigint, link bigint, weight bigint, n1 bigint, n2 bigint")
    got = {(r.entity_id, r.cand_id): r.score for r in top_partners(df, 2).collect()}
    assert got == {(1, -1): 2.0, (2, -1): 1.0, (-1, 1): 2.0, (-1, 2): 1.0}


@pytest.mark.parametrize("combine", ["sum", "max"])
def test_entities_with_the_same_neighbors_share_a_list(spark, monkeypatch, combine):
    """200 entities of each collection with the same neighbour offer one post, not 40,000 pairs."""
    seen = []

    def counted(posts, *args, **options):
        seen.append(posts.count())
        return top_partners(posts, *args, **options)

    monkeypatch.setattr(neighbors, "top_partners", counted)
    rng = random.Random(3)
    linked = [(1, x) for x in range(10, 210)] + [(-1, -x) for x in range(10, 210)]
    linked += [(f, x) for x in range(300, 310) for f in rng.sample([1, 2, 3], 2)]
    linked += [(-f, -x) for x in range(300, 310) for f in rng.sample([1, 2, 3], 2)]
    values = [(1, -1, 0.5), (-1, 1, 0.5), (2, -1, 0.25), (-2, 3, 0.125), (3, -3, 0.75)]
    index = spark.createDataFrame(linked, "entity_id bigint, in_id bigint")
    candidates = spark.createDataFrame(values, "entity_id bigint, cand_id bigint, score double")
    score = {}
    for r in neighbors.neighbor_pairs(candidates, index).collect():
        old = score.get((r.entity_id, r.cand_id), 0.0)
        score[r.entity_id, r.cand_id] = max(old, r.sim) if combine == "max" else old + r.sim
    lists = {}
    for (a, c), s in score.items():
        lists.setdefault(a, []).append((-s, c))
    want = {(a, c, -s, n) for a, found in lists.items() for n, (s, c) in enumerate(sorted(found)[:4], 1)}
    got = neighbors.top_neighbor_candidates(candidates, index, 4, combine)
    assert {(r.entity_id, r.cand_id, r.score, r["rank"]) for r in got.collect()} == want
    assert seen[0] < 50


def test_met_pairs_are_counted_in_tiles(spark, monkeypatch):
    def listed(_):
        raise AssertionError("blocks of many words were joined")

    monkeypatch.setattr(evaluation, "_met_pairs", listed)
    monkeypatch.setattr(tiles, "ROWS", 5)
    monkeypatch.setattr(tiles, "COLUMNS", 7)
    members = random_blocks(12)
    blocks = {}
    for b, e in members:
        blocks.setdefault(b, set()).add(e)
    met = {(a, c) for es in blocks.values() for a in es for c in es if a < 0 <= c}
    truth = [(-(i + 1), i) for i in range(24)]
    df = spark.createDataFrame(members, "block_id bigint, entity_id bigint")
    got = evaluation.evaluate_blocks(df, pair_frame(spark, truth)).first()
    assert (got.tp, got.tp + got.fp) == (sum(p in met for p in truth), len(met))


@pytest.mark.parametrize("in_tiles", [True, False])
def test_repeated_members_count_as_before(spark, monkeypatch, in_tiles):
    """Entities given twice, thrice or once: the tiles count as the folded blocks do."""
    if not in_tiles:
        monkeypatch.setattr(evaluation, "DENSE", 0)
    times = [1, 2, 3]
    members = [(b, e) for b, e in random_blocks(12) for _ in range(times[e % 3])]
    blocks = {}
    for b, e in members:
        blocks.setdefault(b, set()).add(e)
    met = {(a, c) for es in blocks.values() for a in es for c in es if a < 0 <= c}
    df = spark.createDataFrame(members, "block_id bigint, entity_id bigint")
    got = evaluation.evaluate_blocks(df, pair_frame(spark, [(-1, 0)])).first()
    assert got.tp + got.fp == sum(times[a % 3] + times[c % 3] - 1 for a, c in met)


def test_symmetric_candidates_read_the_lists_once(spark):
    """Lists that are not written out are made once, not once for each side."""
    made = spark.sparkContext.accumulator(0)

    def lists(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    data = [(1, -2), (-2, 1), (3, -4), (-6, 5), (1, -6)]
    candidates = spark.createDataFrame(data, "entity_id bigint, cand_id bigint").mapInArrow(lists, "entity_id long, cand_id long")
    got = evaluation.symmetric_candidates(candidates).collect()
    assert sorted(map(tuple, got)) == [(-6, 1), (-6, 5), (-4, 3), (-2, 1)]
    assert made.value == len(data)
