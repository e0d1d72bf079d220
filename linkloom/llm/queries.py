"""The queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    context_tree,
    exact_dedup,
    language_id,
    line_dedup,
    merkle,
    mixing,
    naive_bayes_svm,
    near_dedup,
    packing,
    quality_rules,
    secret_scan,
    sharding,
    whitening,
)
from linkloom.llm.shared import crc_modulo, documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir)).drop("mark")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("mark")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), crc_modulo(F.col("doc_id"), 4) == 2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.document_rules(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "host_rejected",
    )


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(documents(spark, sf_dir), crc_modulo(F.col("doc_id"), 5) == 1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.filter("found", lambda s: s["kind"].isin(list(secret_scan.STRONG)))
    return secret_scan.scan_documents(documents(spark, sf_dir)).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.span_text(strong).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("found")).alias("spans"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.document_lines(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix_units(documents(spark, sf_dir))
    rows = units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.drop("mark", "copies", "copy")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return naive_bayes_svm.classify(docs, labels, crc_modulo(F.col("doc_id"), 5) == 0)


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_context_tree": op6_context_tree,
    "op7_sharding": op7_sharding,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
WITH plain AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS plain
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(plain) AS text_sha256,
         count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id
  FROM plain)
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars END AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         -- crc32 of the id in decimal, eight steps for each byte
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(
             range(1, length(coalesce(doc_id::VARCHAR, '')) + 1),
             lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
           lambda c, b: list_reduce(
             list_prepend(xor(c, b), list_transform(range(8), lambda x: x::BIGINT)),
             lambda r, x: CASE WHEN r % 2 = 1 THEN xor(3988292384::BIGINT, r // 2) ELSE r // 2 END))) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, source,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
         CASE WHEN crc % 5 = 0
              THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(lowered)) || ':' || lowered END)
         END AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
nodes AS (
  SELECT 0 AS level, source, idx, n, leaf AS digest, '' AS run FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)),
         string_agg(digest, '' ORDER BY idx)
  FROM nodes WHERE n > 1 GROUP BY level, source, idx // 16, n),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, idx, n, subroot AS digest, '' AS run FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)),
         string_agg(digest, '' ORDER BY idx)
  FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 16, n),
in_source AS (
  SELECT 0 AS level, doc_id, source, leaf, idx, n, '' AS proof, coalesce(tampered, leaf) AS folded FROM leaves
  UNION ALL
  SELECT p.level + 1, doc_id, p.source, leaf, p.idx // 16, (p.n + 15) // 16,
         proof || left(run, 64 * (p.idx % 16)) || substr(run, 64 * (p.idx % 16) + 65),
         sha256(left(run, 64 * (p.idx % 16)) || folded || substr(run, 64 * (p.idx % 16) + 65))
  FROM in_source p JOIN nodes t
    ON t.level = p.level + 1 AND t.source IS NOT DISTINCT FROM p.source AND t.idx = p.idx // 16 AND p.n > 1),
in_all AS (
  SELECT 0 AS level, doc_id, p.source, leaf, subroot, s.idx, s.n, proof, folded
  FROM in_source p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source WHERE p.n = 1
  UNION ALL
  SELECT p.level + 1, doc_id, source, leaf, subroot, p.idx // 16, (p.n + 15) // 16,
         proof || left(run, 64 * (p.idx % 16)) || substr(run, 64 * (p.idx % 16) + 65),
         sha256(left(run, 64 * (p.idx % 16)) || folded || substr(run, 64 * (p.idx % 16) + 65))
  FROM in_all p JOIN upper_nodes t ON t.level = p.level + 1 AND t.idx = p.idx // 16 AND p.n > 1)
SELECT doc_id, source, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM in_all, (SELECT digest AS root FROM upper_nodes WHERE n = 1) WHERE n = 1
""",
}
