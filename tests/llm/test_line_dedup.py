"""Repeated lines against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.llm import line_dedup


def brute(rows):
    """Places of the removed lines by row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = [], [[] for _ in rows]
    for i in order:
        for at, line in enumerate((rows[i][1] or "").split("\n")):
            words = frozenset(line.encode().split())
            if words:
                if any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen):
                    out[i].append(at)
                seen.append(words)
    return out


def made_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 25]))) for _ in range(60)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randrange(6)):
            parts = rng.choice(lines).split()
            if rng.random() < 0.5:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text.append(rng.choice([" ", "\t"]).join(parts))
        rows.append((i, "\n".join(text)))
    return [*rows, (90, None), (91, "\n\n "), (92, rows[4][1])]


def test_equals_all_pairs(spark):
    rows = made_rows()
    got = line_dedup.document_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    assert {r.doc_id: r.removed_lines for r in got} == want
    assert all(r.n_removed == len(r.removed_lines) for r in got)
    assert {r.doc_id: r.n_lines for r in got} == {i: (t or "").count("\n") + 1 for i, t in rows}


def test_texts_lose_their_lines(spark):
    rows = made_rows() + [(None, "one two"), (None, "one two")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int").coalesce(1)
    got = line_dedup.remove_repeated_lines(docs)
    assert got.columns == docs.columns
    want = []
    for (i, t), gone in zip(rows, brute(rows), strict=True):
        left = [x for at, x in enumerate((t or "").split("\n")) if at not in gone]
        want.append((i, "\n".join(left) if gone else t))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))
    assert line_dedup.document_lines(docs.limit(0)).count() == 0


def test_words_are_kept_for_candidates_alone(spark, monkeypatch):
    kept = {}

    def seen(df, name):
        kept[name] = write(df, name)
        return kept[name]

    write = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", seen)
    near = ["the last word of this long line is a", "the last word of this long line is b"]
    rows = [(i, "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(30)) for j in range(4))) for i in range(20)]
    rows += [(90 + i, line) for i, line in enumerate(near)]
    got = line_dedup.document_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_lines for r in got} == dict(zip([i for i, _ in rows], brute(rows), strict=True))
    arrays = [df.select(F.sum(F.size("words"))).first()[0] for df in kept.values() if "words" in df.columns]
    assert sum(arrays) <= 2 * len(" ".join(near).split())


def test_every_white_space_and_copied_texts(spark):
    line = "one two three four five"
    rows = [(1, "one\ttwo\vthree\ffour\rfive"), (2, f"  one  two\tthree four  five \n \t\n{line} six"), (3, "\u00a0one\u00a0two")]
    rows += [(i, f"{line} six seven\n{line}") for i in range(4, 8)] + [(8, "one two three four five six seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.document_lines(docs).collect()
    assert {r.doc_id: r.removed_lines for r in got} == dict(zip([i for i, _ in rows], brute(rows), strict=True))


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.95, 1.0])
def test_links_of_any_similarity(spark, similarity):
    rows = made_rows(7)
    got = line_dedup.document_lines(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
    sets = {frozenset(line.split()) for _, t in rows for line in (t or "").split("\n")} - {frozenset()}
    links = {s: sum(len(s & o) >= similarity * len(s | o) - 1e-9 for o in sets) - 1 for s in sets}
    want = {i: sum(links.get(frozenset(line.split()), 0) for line in (t or "").split("\n")) for i, t in rows}
    assert {r.doc_id: r.n_links for r in got.collect()} == want
