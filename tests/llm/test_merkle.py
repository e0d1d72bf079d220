"""The manifest against a recursive plain version."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from linkloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf string, idx int, row int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 16]) for i in range(0, len(low), 16)])
    return levels


def path(levels, index):
    out = []
    for level in levels[:-1]:
        first = index // 16 * 16
        out.append((level[first : first + 16], index % 16))
        index //= 16
    return out


def plain(rows):
    def leaf(d, text):
        return h(field(d[0]), field(d[3]), field(d[2]), field(d[4]), field(text))

    by_source = {}
    for d in rows:
        by_source.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: r[:3])
        trees[s] = levels_of([r[2] for r in by_source[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for at, s in enumerate(names):
        for i, (_, _, own, d) in enumerate(by_source[s]):
            steps = path(trees[s], i) + path(top, at)
            text = d[1]
            if zlib.crc32(b"" if d[0] is None else str(d[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded, proof = leaf(d, text), ""
            for run, place in steps:
                proof += "".join(run[:place] + run[place + 1 :])
                folded = h(*run[:place], folded, *run[place + 1 :])
            out.append((d[0], s, own, trees[s][-1][0], root, h(proof), folded, folded == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, 4) for r in rows], SCHEMA)


def check(spark, rows, parts=5):
    got = merkle.manifest(table(spark, rows).repartition(parts)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)
    return got


@pytest.mark.parametrize("counts", [(1,), (16, 17, 1), (256, 257, 2)])
def test_equals_plain_version(spark, counts):
    rows = [
        (i * 3 + 100 * c, f"Text {i} ÀB", None if i % 7 == 0 else "en", f"s{c}", i)
        for c, n in enumerate(counts)
        for i in range(n)
    ]
    check(spark, rows)


def test_three_rounds_in_a_source(spark):
    check(spark, [(i, "A" if i % 2 else "a", "en", "one", 1) for i in range(5_000)])


def test_many_sources(spark):
    check(spark, [(i, f"Q{i}", "en", f"source {i % 270}", 1) for i in range(800)])


def test_odd_rows(spark):
    rows = [(i, "Same", "en", "s", 4) for i in range(20)]
    rows += [(5, "Same", "en", "s", 4)] * 40 + [(None, "Null id", None, None, None)] * 3
    rows += [(None, None, None, None, None), (7, "", "", "", 0), (8, None, "fr", "ß", -5), (9, "long " * 400_000, "en", "s", 9)]
    rows += [(0, "lower only", "en", "s", 1), (i64 := -(2**63), "BIG", "en", "s", i64)]
    got = check(spark, rows)
    assert len(got) == len(rows)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_empty_table(spark):
    assert merkle.manifest(table(spark, [])).collect() == []


def test_queue_delivers_in_label_order():
    queue = [((1, i // 16), i % 16, h(str(i))) for i in range(40)]
    made = list(merkle.climb(list(reversed(queue)), 2))
    assert [m[:2] for m in made] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    runs = merkle.descend({m[:2]: m[3] for m in made}, [(2, 0)], ("above",), 0)
    assert sorted(runs) == list(range(40))
    assert merkle.fold(h("17"), runs[17][:2], merkle.places_of(17, 2)) == made[-1][2]
