"""Near-duplicates against all pairs of a small table."""

import random
from itertools import combinations

import numpy as np
import pytest

from linkloom.llm import near_dedup


def shingle_set(text, width=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_classes(rows):
    """Class id by row, and number of links to other texts, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    kinds = [" ".join((t or "").split()) for _, t in rows]
    links = [set() for _ in rows]
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            head[max(root(i), root(j))] = min(root(i), root(j))
            if kinds[i] != kinds[j]:
                links[i].add(kinds[j])
                links[j].add(kinds[i])
    return [rows[root(i)][0] for i in range(len(rows))], [len(x) for x in links]


def made_texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts + [texts[0], texts[0].replace(" ", "\n"), None, "", " ", None, "one", "one", "w " * 40]


def test_equals_all_pairs(spark):
    rows = list(enumerate(made_texts()))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes, links = brute_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_verified > 0) for r in got} == {
        i: (c, n > 0) for (i, _), c, n in zip(rows, classes, links, strict=True)
    }
    sizes = {c: classes.count(c) for c in classes}
    assert all(r.group_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_chain_beyond_the_pivot(spark):
    """Neighbours of a chain are similar, its ends are not: still one class."""
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(8):
        rows.append((i, " ".join(words)))
        words = words[7:] + [f"x{i}_{j}" for j in range(7)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = near_dedup.near_groups(docs).collect()
    classes, links = brute_classes(rows)
    want = {i: (c, n > 0) for (i, _), c, n in zip(rows, classes, links, strict=True)}
    assert {r.doc_id: (r.class_id, r.n_verified > 0) for r in got} == want


def test_keeps_columns_and_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 1), (2, None, 2), (2, None, 2), (3, "a b c d e f", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    kept = near_dedup.drop_near_copies(docs).collect()
    assert [r.doc_id for r in kept].count(3) == 1 and all(r.doc_id is not None for r in kept)
    assert kept[0].asDict().keys() == {"doc_id", "text", "size"}
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("counted", [False, True])
def test_agreement_is_the_weighted_similarity(counted):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = np.ones(200), np.ones(200)
    if counted:
        x, y = rng.uniform(0.2, 4, 200), rng.uniform(0.2, 4, 200)
    k = 4000
    a, b = near_dedup.dart_signature(ids[:200], x, k), near_dedup.dart_signature(ids[50:250], y, k)
    least = np.minimum(x[50:], y[:150]).sum()
    true = least / (x.sum() + y.sum() - least)
    assert abs((a == b).mean() - true) < 0.04


def test_rarity_is_counted_by_shingle(spark):
    """Every text has shingles of its own, all in one bucket, and 40 that all texts have, each in its own."""
    common = list(range(1, 41))
    sets, copies = [], set()
    for i in range(60):
        own = [(1 + i * 100 + j) << 16 for j in range(40)]
        sets.append((f"{i}a".encode(), common + own))
        sets.append((f"{i}b".encode(), common + own[1:] + [(90_000 + i) << 16]))
        copies.add((f"{i}a".encode(), f"{i}b".encode()))
    open_texts = spark.createDataFrame([(w, w) for w, _ in sets], "words binary, label binary")
    met = near_dedup._rare_pairs(open_texts, spark.createDataFrame(sets, "words binary, shingles array<long>"), 0.8)
    assert {(bytes(r.a), bytes(r.b)) for r in met.collect()} == copies


def test_copies_of_one_text_meet_it_and_not_each_other(spark, monkeypatch):
    """Copies are near the text and not near one another."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        copy = list(base)
        for at in rng.sample(range(150), 3):
            copy[at] = f"own{i}_{at}"
        rows.append((i, " ".join(copy)))
    rare_pairs, met = near_dedup._rare_pairs, []

    def counted(*args):
        pairs = rare_pairs(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_rare_pairs", counted)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes, _ = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: c for (i, _), c in zip(rows, classes, strict=True)}
    assert sum(met) <= len(rows)
