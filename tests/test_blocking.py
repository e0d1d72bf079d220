from pyspark.sql import functions as F

from linkloom.operators import blocking
from linkloom.sources import readers
from tests.conftest import rows

# fixed values: what is expected of ``block_lines`` below is golden


def listed(df, key, value):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[value])
    return out


def test_parse_blocks(spark, block_lines):
    blocks = listed(readers.parse_blocks(block_lines), "block_id", "entity_id")
    assert blocks == {
        0: {1, 2, 3, 4, 5, -1, -2, -3, -4, -5},
        1: {3, 4, 5, -1, -5},
        2: {5, -5},
        3: {5},
    }


def test_parse_blocks_drops_malformed_lines(spark):
    lines = spark.createDataFrame([("7",), ("7\t",), ("8\t1#;-1#\tx",), ("9\t1#;-2",)], "value string")
    assert rows(readers.parse_blocks(lines)) == [(9, -2), (9, 1)]


def test_block_utility(block_lines):
    utility = blocking.block_utility(readers.parse_blocks(block_lines))
    assert utility.count() == 17
    by_block = {
        (r.block_id, r.utility): r.n
        for r in utility.groupBy("block_id", "utility").agg(F.count("*").alias("n")).collect()
    }
    assert by_block == {(0, 5): 10, (1, 3): 5, (2, 1): 2}


def test_entity_index(block_lines):
    index = blocking.block_filtering(readers.parse_blocks(block_lines))
    assert index.count() == 15
    ordered = {}
    for r in index.orderBy("entity_id", "pos").collect():
        ordered.setdefault(r.entity_id, []).append(r.block_id)
    assert ordered == {
        1: [0], 2: [0], -2: [0], -3: [0], -4: [0],
        3: [1, 0], 4: [1, 0], -1: [1, 0],
        5: [2, 1], -5: [2, 1],
    }


def test_rebuilt_blocks_and_stats(block_lines):
    index = blocking.block_filtering(readers.parse_blocks(block_lines))
    sized = blocking.rebuild_blocks(index)
    assert listed(sized, "block_id", "entity_id") == {
        0: {1, 2, 3, 4, -1, -2, -3, -4},
        1: {3, 4, 5, -1, -5},
        2: {5, -5},
    }
    stats = blocking.blocking_stats(index, sized).first().asDict()
    assert {k: int(stats[k]) for k in ("assignments", "entities", "clean_blocks", "comparisons", "k")} == {
        "assignments": 15, "entities": 10, "clean_blocks": 3, "comparisons": 23, "k": 1,
    }
    assert stats["bcin"] == 1.5
    assert blocking.default_k(index) == 1
    counts = rows(blocking.side_counts(index))
    assert counts == [(5, 5)]


def test_expansion(spark, block_lines):
    index = blocking.block_filtering(readers.parse_blocks(block_lines))
    extra = spark.createDataFrame([(-100, -1)], "entity_id bigint, block_id bigint")
    sized = blocking.rebuild_blocks(index.select("entity_id", "block_id").unionByName(extra))
    pairs = blocking.candidate_pairs(sized)
    assert pairs.count() == 23
    per_entity = {}
    for r in pairs.collect():
        per_entity.setdefault((r.block_id, r.d1_id), (r.n1, set()))[1].add(r.d2_id)
        per_entity.setdefault((r.block_id, r.d2_id), (r.n2, set()))[1].add(r.d1_id)
    for e in (1, 2, 3, 4):
        assert per_entity[0, e] == (4, {-1, -2, -3, -4})
        assert per_entity[0, -e] == (4, {1, 2, 3, 4})
    for e in (3, 4, 5):
        assert per_entity[1, e] == (3, {-1, -5})
    for e in (-1, -5):
        assert per_entity[1, e] == (2, {3, 4, 5})
    assert per_entity[2, 5] == (1, {-5}) and per_entity[2, -5] == (1, {5})
    factored = {(r.block_id, r.entity_id): (r.n_same, r.n_candidates) for r in blocking.candidate_counts(sized).collect()}
    assert factored == {k: (same, len(others)) for k, (same, others) in per_entity.items()}


def test_blocks_per_entity(block_lines):
    index = blocking.block_filtering(readers.parse_blocks(block_lines))
    counts = dict(rows(blocking.blocks_per_entity(index)))
    assert counts == {1: 1, 2: 1, -2: 1, -3: 1, -4: 1, 3: 2, 4: 2, -1: 2, 5: 2, -5: 2}


def test_token_blocking(spark):
    docs = spark.createDataFrame(
        [(0, "red apple pie"), (1, "red pear"), (-1, "Red apple"), (-2, "red plum"), (-3, "red")],
        "entity_id bigint, text string",
    )
    blocks = blocking.token_blocking(docs)
    assert rows(blocks) == [
        ("apple", -1), ("apple", 0), ("red", -3), ("red", -2), ("red", -1), ("red", 0), ("red", 1),
    ]


def test_words_of_any_script(spark):
    docs = spark.createDataFrame([(0, "Été über_x"), (-1, "été, ÜBER Привет"), (1, "привет 4")], "entity_id bigint, text string")
    assert {b for b, _ in rows(blocking.token_blocking(docs))} == {"été", "über", "привет"}


def test_marks_belong_to_their_words(spark):
    # A vowel sign and a virama in Devanagari, an accent as a character of its own.
    words = ["\u0939\u093f\u0928\u094d\u0926\u0940", "cafe\u0301"]
    docs = spark.createDataFrame([(1, " ".join(words)), (-2, "; ".join(words))], "entity_id bigint, text string")
    assert {b for b, _ in rows(blocking.token_blocking(docs))} == set(words)
