import random

import pytest
from pyspark.sql import functions as F

from linkloom.sources import readers, writers
from tests.conftest import pairs, ranked, rows


def lines(spark, items):
    return spark.createDataFrame([(i,) for i in items], "value string")


def test_entity_ids(spark):
    df = lines(spark, ["<http://A/x>\t0", "<http://a/Y>\t7"])
    assert rows(readers.parse_entity_ids(df)) == [("<http://a/x>", 0), ("<http://a/y>", 7)]
    assert rows(readers.parse_entity_ids(df, 2)) == [("<http://a/x>", -1), ("<http://a/y>", -8)]


def test_triples(spark):
    df = lines(spark, ['<S> <P> <O> .', '<s> <name> "Ann Lee" .', "<s> <p>", "<s> <p> <o> "])
    assert rows(readers.parse_relations(df)) == [("<s>", "<p>", "<o>"), ("<s>", "<p>", "<o>")]
    assert rows(readers.parse_statements(df)) == [
        ("<s>", "<name>", '"ann lee"'), ("<s>", "<p>", "<o>"), ("<s>", "<p>", "<o>"),
    ]


def test_tab_separated_triples(spark):
    df = lines(spark, ["a\tlabel\tAnn Lee", "a\tp"])
    assert rows(readers.parse_relations(df, "\t")) == [("a", "label", "ann lee")]


def test_separators():
    assert readers.triple_separator("x/y.tsv") == "\t"
    assert readers.triple_separator("x/y.nt") == " "


def test_ground_truth(spark):
    e1 = readers.parse_entity_ids(lines(spark, ["<http://a/1>\t1", "<http://a/2>\t2", "<http://a/3>\t3"]))
    e2 = readers.parse_entity_ids(
        lines(spark, ["<http://dbpedia.org/resource/x%28y%29>\t0", "<http://b/2>\t1", "<http://b/3>\t2"]), 2
    )
    gt = lines(
        spark,
        [
            "<http://A/1>,<http://dbpedia.org/resource/X(Y)>",
            "<http://a/2>,<http://b/2>",
            "<http://a/2>,<http://b/2>",
            "<http://a/2>,<http://b/3>",
            "<http://a/3>,<http://b/3>",
            "<http://a/9>,<http://b/2>",
            "<http://a/1>",
        ],
    )
    got = readers.parse_ground_truth(gt, e1, e2)
    assert rows(got) == [(-2, 2), (-1, 1)]
    assert rows(readers.parse_ground_truth(gt, e1, e2, encode_right=False)) == [(-2, 2)]


def test_ground_truth_ids(spark):
    assert rows(readers.parse_ground_truth_ids(lines(spark, ["4\t4", "1\t0"]))) == [(-5, 4), (-1, 1)]


def test_match_round_trip(spark, tmp_path):
    matches = pairs(spark, [(-5, 4), (-1, 0)])
    writers.write_matches(matches, str(tmp_path / "m"))
    text = readers.read_lines(spark, str(tmp_path / "m"))
    assert sorted(r.value for r in text.collect()) == ["(-1,0)", "(-5,4)"]
    assert rows(readers.parse_matches(text)) == rows(matches)


def test_candidate_round_trip(spark, tmp_path):
    cands = ranked(spark, {-1: [(3, 0.5), (1, 0.25)], 3: [(-1, 0.5)]})
    writers.write_candidates(cands, str(tmp_path / "c"))
    assert rows(writers.read_candidates(spark, str(tmp_path / "c"))) == rows(cands)
    assert rows(writers.candidate_lines(cands)) == [("-1\t3:0.5,1:0.25",), ("3\t-1:0.5",)]
    writers.write_candidate_text(cands, str(tmp_path / "t"))
    assert readers.read_lines(spark, str(tmp_path / "t")).count() == 2


@pytest.mark.parametrize("range_size", [2, 100])
def test_assign_entity_ids(spark, range_size):
    order = ["b", "a", "b", "c", "a", "d"]
    df = spark.createDataFrame([(s, i * 3) for i, s in enumerate(order)], "s string, position bigint")
    assert rows(readers.assign_entity_ids(df, range_size)) == [("a", 1), ("b", 0), ("c", 2), ("d", 3)]


def test_assign_entity_ids_from_files(spark, tmp_path):
    path = str(tmp_path / "triples")
    spark.range(0, 200, 1, 4).select(
        F.concat(F.lit("<s"), (F.col("id") % 50).cast("string"), F.lit("> <p> <o> .")).alias("value")
    ).write.text(path)
    positioned = readers.with_positions(readers.read_lines(spark, path))
    statements = positioned.select(F.split("value", " ")[0].alias("s"), "position")
    got = readers.assign_entity_ids(statements)
    assert sorted(r.entity_id for r in got.collect()) == list(range(50))
    first = {}
    for r in positioned.orderBy("position").collect():
        first.setdefault(r.value.split(" ")[0], len(first))
    assert {r.uri: r.entity_id for r in got.collect()} == first


def test_one_id_per_uri(spark):
    lines = spark.createDataFrame([("<A/Apple>\t1",), ("<a/apple>\t2",), ("<a/b>\t0",)], "value string")
    first = {tuple(r) for r in readers.parse_entity_ids(lines).collect()}
    assert first == {("<a/apple>", 2), ("<a/b>", 0)}
    assert {tuple(r) for r in readers.parse_entity_ids(lines, collection=2).collect()} == {("<a/apple>", -3), ("<a/b>", -1)}


def plain_order(texts, encode=lambda x: x):
    """Subjects of lines in order, first appearance first."""
    return list(dict.fromkeys(encode(line.split(" ")[0]) for text in texts for line in text.splitlines()))


def write_files(folder, texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text)
    return str(folder)


def test_subjects_stand_in_the_order_of_files(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    # The large files come last by name but first by size; one is empty.
    sizes = {"part-0": 3, "part-1": 40, "part-2": 0, "part-3": 4000, "part-4": 900}
    texts = {
        name: "".join(f"<http://X/S{rng.randrange(1500)}> <p> <o{i}> .\n" for i in range(n)) for name, n in sizes.items()
    }
    path = write_files(tmp_path / "triples", texts)
    monkeypatch.setattr(readers, "LINE_RANGE", 64)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("7000", before):  # several splits of a file, then several files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            placed = readers.read_placed_lines(spark, path)
            got = {r.uri: r.entity_id for r in readers.number_subjects(placed).collect()}
            assert got == {s: i for i, s in enumerate(plain_order(texts.values(), str.lower))}
            written = {r.uri: r.entity_id for r in readers.number_subjects(placed, as_written=True).collect()}
            assert written == {s: i for i, s in enumerate(plain_order(texts.values()))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_truth_by_places_in_triple_files(spark, tmp_path):
    first = {"a": "<X> <p> <o>\n<y> <p> <o>\n", "b": "<z> <p> <o>\n<X> <p> <q>\n"}
    second = {"a": "<k> <p> <o>\n", "b": "<l> <p> <o>\n<m> <p> <o>\n"}
    subjects = [
        readers.number_subjects(
            readers.read_placed_lines(spark, write_files(tmp_path / name, texts)), as_written=True
        )
        for name, texts in (("one", first), ("two", second))
    ]
    gt = lines(spark, ["<X>,<m>", "<z>,<k>", "<y>,<none>", "<none>,<l>", "<x>,<l>", "<z>,<m>", "<y>"])
    got = readers.parse_ground_truth_by_subjects(gt, *subjects)
    # Kept as they are: two partners of -2, the unknown as -1, number 0 of collection 2.
    assert rows(got) == sorted([(-2, 0), (0, 2), (-1, 1), (-1, -1), (-1, -1), (-2, 2), (-1, 1)])


def test_blocks_with_more_entities_than_a_line_holds(spark):
    data = [(1, i) for i in range(30)] + [(1, -i) for i in range(1, 9)] + [(2, -3), (3, 7)]
    members = spark.createDataFrame(data, "block_id bigint, entity_id bigint")
    written = writers.block_lines(members, 5)
    assert rows(readers.parse_blocks(written)) == sorted(data)
    assert written.count() > 8
    assert rows(writers.block_lines(members.where("block_id > 1"))) == [("2\t;-3#",), ("3\t7#;",)]
    assert rows(writers.block_lines(members.where("false"))) == []
