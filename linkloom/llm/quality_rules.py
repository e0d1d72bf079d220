"""Quality rules by host: failure rates of each rule, shrunk by an empirical beta prior.

Each document is measured once (word, symbol, line and repetition counts).  The
failures of every rule are summed by host; over the hosts a beta prior is fitted
to each rule by its moments, and a host's rate becomes the posterior mean.  So a
host with few documents stays near the common rate, a large one near its own.
A host is rejected when the shrunk rate of any rule exceeds ``host_limit``; the
verdict is joined back to the documents.

Measuring runs in Arrow batches with numpy; sums by host are partial
aggregates, so a hot host costs no more than any other.  The verdicts are one
row per rejected host.

Defined cases: a null text has no words and fails the base rules; null hosts
form one host of their own; repeated rows count once each; a host rule can only
reject, so a document that fails the base rules is never kept; with an empty
table there is no host; other columns are carried along by
``keep_good_documents`` and not read by ``document_rules``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.shared import free_name
from linkloom.runtime import materialize

WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
#: A host is rejected when more than this share of its documents fails one rule.
HOST_LIMIT = 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of WINDOW words that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) > len(words) - WINDOW:  # too few repeated words for a repeated window
        return 0
    # names of 2-, 4- and 8-word windows: equal names if and only if equal words
    width = 1
    while width < WINDOW:
        pairs = ids[:-width] * np.int64(len(words) + 1) + ids[width:]
        kinds, ids = np.unique(pairs, return_inverse=True)
        if len(kinds) == len(pairs):
            return 0
        width *= 2
    often = np.bincount(ids)[ids] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of MEASURES."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: exactly the six ASCII white spaces
    lines = Counter(line for line in raw.split(b"\n") if line.strip())
    n_lines = sum(lines.values())
    word_chars = sum(len(w) for w in words) if raw.isascii() else len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), word_chars, symbols, n_lines, n_lines - len(lines), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        rows = [measure(text[i].as_py()) for i in range(len(text))]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        arrays = [pa.array(c, pa.int64()) for c in columns]
        names = [part.split()[0] for part in MEASURES.split(", ")]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *arrays], names=[*kept, *names]
        )


def _failing(text_at: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the verdict of the base rules to whole rows."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = []
            for text in batch.column(text_at):
                words = (text.as_py() or "").encode().split()
                failed.append(len(words) < MIN_WORDS or 100 * repeated_words(words) > 30 * len(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed, pa.bool_())], names=[*batch.schema.names, name]
            )

    return judged


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules whose failures are summed by host."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "words": (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
    }


def host_rates(measured: DataFrame, host: str = "host") -> DataFrame:
    """One row per host and rule: documents, failures, shrunk rate.

    The prior of a rule is fitted by the moments of the hosts' rates: mean m
    (over documents) and variance v between hosts beyond the sampling noise;
    its strength is s = m(1-m)/v - 1.  Without variance beyond noise s is the
    mean number of documents by host.
    """
    named = rules()
    by_host = measured.groupBy(host).agg(
        F.count("*").alias("n"), *(F.sum(r.cast("long")).alias(k) for k, r in named.items())
    )
    long = by_host.select(
        host, "n", F.explode(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named))).alias("rule", "failed")
    )
    prior = (
        long.groupBy("rule")
        .agg(
            (F.sum("failed") / F.sum("n")).alias("m"),
            F.avg("n").alias("size"),
            F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square"),
            F.sum("n").alias("all"),
            F.count("*").alias("hosts"),
            F.sum("failed").alias("failures"),
        )
        .withColumn(
            "between",
            # weighted variance of the rates, less what binomial sampling adds
            (F.col("square") - F.col("failures") * F.col("m")) / F.col("all")
            - F.col("m") * (1 - F.col("m")) * F.col("hosts") / F.col("all"),
        )
        .select(
            "rule",
            "m",
            F.when(
                F.col("between") > 1e-9,
                F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("between") - 1),
            )
            .otherwise(F.col("size"))
            .alias("strength"),
        )
    )
    return long.join(prior, "rule").select(
        host,
        "rule",
        "n",
        "failed",
        ((F.col("failed") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength"))).alias("rate"),
    )


def document_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, host, measures, base_failed, host_rejected, kept."""
    measured = _measures(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    )
    bad = _bad_hosts(measured, host_limit).withColumn("_bad", F.lit(True))
    return (
        measured.join(bad, F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("host_rejected", F.coalesce("_bad", F.lit(False)))
        .withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected")))
        .drop("_host", "_bad")
    )


def _measures(given: DataFrame) -> DataFrame:
    kinds = dict(given.dtypes)
    return materialize(
        given.mapInArrow(_measured, f"doc_id {kinds['doc_id']}, host {kinds['host']}, {MEASURES}"),
        "quality-measures",
    )


def _bad_hosts(measured: DataFrame, host_limit: float) -> DataFrame:
    return (
        host_rates(measured).filter(F.col("rate") > host_limit).select(F.col("host").alias("_host")).distinct()
    )


def keep_good_documents(
    docs: DataFrame, *, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Texts are measured twice, once for the hosts and once for their own verdict,
    so that they neither move nor are copied.
    """
    measured = _measures(docs.select(F.lit(0).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")))
    bad = materialize(_bad_hosts(measured, host_limit), "bad-hosts")
    failed, rejected = free_name(docs.columns, "failed"), free_name(docs.columns, "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField(failed, T.BooleanType())])
    judged = docs.mapInArrow(_failing(docs.columns.index(text), failed), schema).filter(~F.col(failed)).drop(failed)
    bad = bad.withColumnRenamed("_host", rejected)
    return judged.join(bad, F.col(host).eqNullSafe(F.col(rejected)), "left_anti")
