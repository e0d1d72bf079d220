"""Mixing against the given targets, over many rounds and many sources."""

import math
from fractions import Fraction

import pytest
from linkloom.llm import mixing


def furthest(targets, slots):
    """Largest deviation in blocks of any source from its given target, at every slot."""
    total = sum(map(Fraction, targets.values()))
    # no source is used up before that slot
    plan = mixing.phases({k: math.ceil(slots * Fraction(w) / total) + 1 for k, w in targets.items()}, targets)
    worst = 0
    for name, w in targets.items():
        placed = []
        for first, last, parts, each, offset, places in plan[name]:
            placed += [offset + (k // parts) * each + places[k % parts] for k in range(last - first)]
        share = Fraction(w) / total
        for k, at in enumerate(sorted(p for p in placed if p < slots)):
            # just before and just after a slot of its own the deviation is largest
            worst = max(worst, abs(k - at * share), abs(k + 1 - (at + 1) * share))
    return worst


@pytest.mark.parametrize(
    ("targets", "slots"),
    [
        ({"a": 0.9, "b": 0.1}, 20_000),
        ({"a": 0.9999, "b": 0.0001}, 30_000),
        ({f"s{i}": 0.5 if i == 0 else 0.5 / 99 for i in range(100)}, 5_000),
        ({f"s{i}": 0.5 if i == 0 else 0.5 / 999 for i in range(1_000)}, 5_000),
    ],
)
def test_given_targets_hold_within_one_block(targets, slots):
    assert furthest(targets, slots) < 1


def test_slots_of_documents_follow_the_given_targets(spark):
    rows = [(i, "x" * 15, "a" if i % 2 else "b") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = mixing.mix_units(docs, targets={"a": 0.9, "b": 0.1}, block_bytes=16).collect()
    assert sorted(u.slot for u in units) == list(range(4_000))
    first = sorted(u.slot for u in units if u.source == "a" and u.slot < 2_000)
    assert all(abs(k + 1 - 0.9 * (at + 1)) < 1 for k, at in enumerate(first))


def test_phases_may_end_with_a_stretch():
    plan = mixing.phases({"a": 16, "b": 40}, {"a": 1, "b": 1}, 32)
    assert [p[:2] for p in plan["a"]] == [(0, 16)]
    assert sum(last - first for first, last, *_ in plan["b"]) == 40
