"""Two collections to link, derived from the given tables.

* *documents*: even ``doc_id`` form collection 1, odd ones collection 2.
* *star*: nations, customers, suppliers, orders and parts described twice as
  triples, with different vocabularies.  Collection 2 has no names among its
  blocks, so customers are told apart by values and by their orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import InputPaths, Resolver, ResolverConfig
from linkloom.functions import ids
from linkloom.operators import blocking
from linkloom.runtime import fresh_path, materialize
from linkloom.sources import readers, writers

KINDS = {"nation": 0, "customer": 1, "supplier": 2, "order": 3, "part": 4}
TABLES = {
    "nation": ("nation", "n_nationkey"),
    "customer": ("customer", "c_custkey"),
    "supplier": ("supplier", "s_suppkey"),
    "order": ("orders", "o_orderkey"),
    "part": ("part", "p_partkey"),
}
# predicate names in collection 1 and 2
PREDICATES = {
    1: {"name": "name", "nation": "nation", "segment": "segment", "customer": "customer", "status": "status"},
    2: {"name": "label", "nation": "locatedIn", "segment": "market", "customer": "placedBy", "status": "state"},
}
NAME_ATTRIBUTES = {1: ("<http://kb1/name>",), 2: ("<http://kb2/label>",)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(lines: DataFrame, name: str) -> DataFrame:
    """Lines as files, the form in which triples and ids arrive."""
    return materialize(lines, name)


# ---- documents ----------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    signed = F.when(number % 2 == 0, number).otherwise(ids.encode_second(number))
    return table(spark, sf, "documents").select(signed.alias("entity_id"), "text")


def document_members(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.token_members(documents(spark, sf))


def document_resolver(spark: SparkSession, sf: str, **config) -> Resolver:
    return Resolver(document_members(spark, sf), config=ResolverConfig(**config))


def document_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of collection 2 with exactly one equal text in collection 1."""
    texts = documents(spark, sf).select("entity_id", F.md5("text").alias("digest"))
    sole = (
        texts.where("entity_id >= 0")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("d1_id"))
        .where("n = 1")
    )
    return (
        texts.where("entity_id < 0").join(sole, "digest").select(F.col("entity_id").alias("d2_id"), "d1_id")
    )


# ---- star schema --------------------------------------------------------


def file_id(kind: str) -> Column:
    return F.col(TABLES[kind][1]).cast("bigint") * len(KINDS) + KINDS[kind]


def row_key(entity_id: Column) -> Column:
    """The key of the row that an entity of either collection describes."""
    number = F.when(ids.is_first(entity_id), entity_id).otherwise(-entity_id - 1)
    return F.floor(number / len(KINDS))


def uri(collection: int, kind: str, key: str) -> Column:
    return F.concat(F.lit(f"<http://KB{collection}/{kind}/"), F.col(key).cast("string"), F.lit(">"))


def _line(collection: int, kind: str, predicate: str, value: Column) -> Column:
    p = PREDICATES[collection][predicate]
    return F.concat(uri(collection, kind, TABLES[kind][1]), F.lit(f" <http://kb{collection}/{p}> "), value, F.lit(" ."))


def _text(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column), F.lit('"'))


def triple_lines(spark: SparkSession, sf: str, collection: int) -> DataFrame:
    facts = {
        "nation": [("name", _text("n_name"))],
        "customer": [
            ("name", _text("c_name")),
            ("nation", uri(collection, "nation", "c_nationkey")),
            ("segment", _text("c_mktsegment")),
        ],
        "supplier": [("name", _text("s_name")), ("nation", uri(collection, "nation", "s_nationkey"))],
        "order": [("customer", uri(collection, "customer", "o_custkey")), ("status", _text("o_orderstatus"))],
        "part": [("name", _text("p_name"))],
    }
    out = None
    for kind, statements in facts.items():
        lines = F.array(*[_line(collection, kind, p, v) for p, v in statements])
        part = table(spark, sf, TABLES[kind][0]).select(F.explode(lines).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def id_lines(spark: SparkSession, sf: str, collection: int) -> DataFrame:
    out = None
    for kind, (name, key) in TABLES.items():
        line = F.concat_ws("\t", uri(collection, kind, key), file_id(kind).cast("string"))
        part = table(spark, sf, name).select(line.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def truth_lines(spark: SparkSession, sf: str) -> DataFrame:
    """URI pairs of the same row; orders are also paired with their customer's row.

    The latter pairs break the one-partner rule for orders and must vanish.
    """
    out = None
    for kind, (name, key) in TABLES.items():
        own = F.concat_ws(",", uri(1, kind, key), uri(2, kind, key))
        lines = [own]
        if kind == "order":
            extra = F.concat_ws(",", uri(1, "customer", "o_custkey"), uri(2, kind, key))
            lines.append(F.when(F.col("o_orderstatus") == "P", extra))
        part = table(spark, sf, name).select(F.explode(F.array(*lines)).alias("value")).where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out


def star_members(spark: SparkSession, sf: str) -> DataFrame:
    def block(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), value.cast("string"))

    def bucket(column: str, width: int) -> Column:
        return F.floor(F.col(column) / width)

    evidence = {
        "nation": ([block("name", F.col("n_name")), block("region", F.col("n_regionkey"))], []),
        "customer": (
            [
                block("nation", F.col("c_nationkey")),
                block("segment", F.col("c_mktsegment")),
                block("balance", bucket("c_acctbal", 10)),
            ],
            [block("name", F.col("c_name"))],
        ),
        "supplier": (
            [block("nation", F.col("s_nationkey")), block("balance", bucket("s_acctbal", 10))],
            [block("name", F.col("s_name"))],
        ),
        "order": (
            [
                block("date", F.col("o_orderdate").cast("date")),
                block("price", bucket("o_totalprice", 1000)),
                block("status", F.col("o_orderstatus")),
            ],
            [],
        ),
    }
    out = None
    for kind, (shared, only_first) in evidence.items():
        number = file_id(kind)
        first = F.struct(number.alias("entity_id"), F.array(*shared, *only_first).alias("blocks"))
        second = F.struct(ids.encode_second(number).alias("entity_id"), F.array(*shared).alias("blocks"))
        part = (
            table(spark, sf, TABLES[kind][0])
            .select(F.explode(F.array(first, second)).alias("e"))
            .select("e.entity_id", F.explode("e.blocks").alias("block_id"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def star_entities(spark: SparkSession, sf: str, collection: int) -> DataFrame:
    return readers.parse_entity_ids(written(id_lines(spark, sf, collection), "id-lines"), collection)


def star_statements(spark: SparkSession, sf: str, collection: int) -> DataFrame:
    return readers.parse_statements(written(triple_lines(spark, sf, collection), "triple-lines"))


def star_truth(spark: SparkSession, sf: str) -> DataFrame:
    return readers.parse_ground_truth(
        written(truth_lines(spark, sf), "truth-lines"), star_entities(spark, sf, 1), star_entities(spark, sf, 2)
    )


def star_resolver(spark: SparkSession, sf: str, **config) -> Resolver:
    settings = {"label_attributes1": NAME_ATTRIBUTES[1], "label_attributes2": NAME_ATTRIBUTES[2], **config}
    return Resolver(
        star_members(spark, sf),
        star_statements(spark, sf, 1),
        star_statements(spark, sf, 2),
        star_entities(spark, sf, 1),
        star_entities(spark, sf, 2),
        config=ResolverConfig(**settings),
    )


def order_block_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Block lines ``order TAB part#...;-(supplier+1)#...`` from the lines of each order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_partkey")).alias("parts"),
        F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"),
    )
    parts = F.transform("parts", lambda p: F.concat(p.cast("string"), F.lit("#")))
    suppliers = F.transform("suppliers", lambda s: F.concat(ids.encode_second(s).cast("string"), F.lit("#")))
    value = F.concat(
        F.col("l_orderkey").cast("string"), F.lit("\t"), F.array_join(parts, ""), F.lit(";"), F.array_join(suppliers, "")
    )
    return lines.select(value.alias("value"))


def supplier_members(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of suppliers: their parts in collection 1, the orders of these in collection 2."""
    lines = table(spark, sf, "lineitem")
    block = F.col("l_suppkey").cast("bigint").alias("block_id")
    parts = lines.select(block, F.col("l_partkey").cast("bigint").alias("entity_id"))
    orders = lines.select(block, ids.encode_second(F.col("l_orderkey").cast("bigint")).alias("entity_id"))
    return parts.unionByName(orders).distinct()


# ---- files in order -----------------------------------------------------


def ordered_files(lines: DataFrame, name: str) -> str:
    """Write ``(dir, key, value)`` as files that stand by ``dir`` and ``key`` when taken by name.

    The folders are of very unequal size; Spark would read large ones first.
    """
    path = fresh_path(lines.sparkSession, name)
    placed = lines.repartitionByRange("dir", "key").sortWithinPartitions("dir", "key")
    placed.select("dir", "value").write.partitionBy("dir").text(path)
    return path


def order_statement_files(spark: SparkSession, sf: str, collection: int) -> str:
    """Who placed each order, with the customer as subject.

    A folder holds the order keys of one length in bits.  Within a folder the
    keys of collection 1 fall and those of collection 2 rise.
    """
    predicate = PREDICATES[collection]["customer"]
    line = F.concat(
        uri(collection, "customer", "o_custkey"), F.lit(f" <http://kb{collection}/{predicate}> "),
        uri(collection, "order", "o_orderkey"), F.lit(" ."),
    )
    key = F.col("o_orderkey").cast("bigint")
    return ordered_files(
        table(spark, sf, "orders").select(
            (F.length(F.bin(key)) + 100).alias("dir"), (-key if collection == 1 else key).alias("key"), line.alias("value")
        ),
        "order-statements",
    )


def customer_pair_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The URI pair of every customer, also of those that no order names."""
    pair = F.concat_ws(",", uri(1, "customer", "c_custkey"), uri(2, "customer", "c_custkey"))
    return table(spark, sf, "customer").select(pair.alias("value"))


def star_files(spark: SparkSession, sf: str) -> tuple[InputPaths, str]:
    """The star collections as files of blocks, triples, ids and truth.

    Blocks get numbers that rise with their names, so that ties among blocks of
    one size fall as they do by name.
    """
    folder = fresh_path(spark, "star-files")
    members = materialize(star_members(spark, sf), "members")
    names = members.select("block_id").distinct().select(
        F.lit(100).alias("dir"), F.col("block_id").alias("key"), F.col("block_id").alias("value")
    )
    placed = readers.read_placed_lines(spark, ordered_files(names, "block-names"))
    numbers = readers.number_subjects(placed, separator="\t", as_written=True)
    numbered = members.withColumnRenamed("block_id", "uri").join(numbers.withColumnRenamed("entity_id", "block_id"), "uri")
    writers.write_blocks(numbered.select("block_id", "entity_id"), f"{folder}/blocks")
    for c in (1, 2):
        triple_lines(spark, sf, c).write.text(f"{folder}/triples{c}")
        id_lines(spark, sf, c).write.text(f"{folder}/ids{c}")
    truth_lines(spark, sf).write.text(f"{folder}/truth")
    paths = InputPaths(*(f"{folder}/{name}" for name in ("blocks", "triples1", "triples2", "ids1", "ids2")))
    return paths, f"{folder}/truth"
