from pyspark.sql import functions as F

from linkloom.functions import ids, scores, text
from tests.conftest import rows


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", column(F.col("v"))).collect())]


def test_uri_encode(spark):
    # fixed values: golden encodings
    given = [
        "<http://dbpedia.org/resource/Hello(film)>",
        "<http://non-dbpedia.com>",
        "<http://dbpedia.org/resource/100%25>",
        "<http://dbpedia.org/resource/caf\\u00e9>",
        "<http://dbpedia.org/resource/a\\\\u00e9b>",
        '<http://dbpedia.org/resource/say\\"x>',
        "<http://dbpedia.org/resource/a b*c~d>",
    ]
    assert values(spark, given, text.uri_encode) == [
        "<http://dbpedia.org/resource/Hello%28film%29>",
        "<http://non-dbpedia.com>",
        "<http://dbpedia.org/resource/100%25>",
        "<http://dbpedia.org/resource/caf%C3%A9>",
        "<http://dbpedia.org/resource/a%C3%A9b>",
        "<http://dbpedia.org/resource/say%22x>",
        "<http://dbpedia.org/resource/a+b*c%7Ed>",
    ]


def test_normalize_label(spark):
    given = ['"Crete"@en', "Bob!", "Ab-C! é9", "!!"]
    assert values(spark, given, text.normalize_label) == ["creteen", "bob", "abc 9", ""]


def test_tokens(spark):
    given = ["The cat, the CAT; x9", "...", ""]
    assert values(spark, given, text.tokens) == [["the", "cat", "x9"], [], []]


def test_ids_round_trip(spark):
    df = spark.range(3).select("id", ids.encode_second(F.col("id")).alias("e"))
    df = df.withColumn("back", ids.decode_second(F.col("e")))
    assert rows(df) == [(0, -1, 0), (1, -2, 1), (2, -3, 2)]


def test_fixed_point_thirds_reach_one(spark):
    # three blocks of weight 1/3 make exactly 1
    third = spark.range(3).select(scores.to_fixed(scores.arcs_weight(F.lit(7), F.lit(1))).alias("w"))
    assert third.agg(scores.from_fixed(F.sum("w")).alias("s")).first()["s"] == 1.0


def test_order_by_score(spark):
    data = spark.createDataFrame([(3, 0.5), (2, 0.6), (4, 0.4), (1, 0.8), (5, 0.0)], "e int, v double")
    assert [r.e for r in data.orderBy(F.desc("v")).collect()] == [1, 2, 3, 4, 5]
    assert [r.e for r in data.orderBy("v").collect()] == [5, 4, 3, 2, 1]
