"""Language identification by held-out accuracy; context trees against plain recursion."""

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import context_tree, language_id
from linkloom.llm.shared import crc_modulo


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, crc_modulo(F.col("doc_id"), 4) == 2).join(
        docs.select("doc_id", "lang", "text"), "doc_id"
    )
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert {r.held_out for r in rows} == {r.doc_id and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows} | {False}


def test_languages_of_odd_rows(spark):
    rows = [(i, "der und die das", "de") for i in range(6)] + [(7, None, "de"), (8, "12 !", None), (9, "été", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, F.lit(False)).collect()}
    assert (got[7].lang_pred, got[7].score) == ("und", 0.0) and got[8].lang_pred == "und"
    assert got[9].lang_pred == "de"
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.limit(0), F.lit(False)).count() == 0


def plain_subwords(text):
    out = np.zeros(language_id.BUCKETS)
    clean = language_id.NO_LETTER.sub(" ", text.lower()).strip()
    for word in clean.split(" "):
        padded = f" {word} "
        for n in range(1, 5):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram == " ":
                    continue
                code = 0
                for m, c in enumerate(gram):
                    code = (code + ord(c) + 1) * 0x9E3779B1 % 2**32
                    code ^= code >> 15
                out[(code >> 3) % language_id.BUCKETS] += 1
    return out


def test_subwords_stay_inside_words():
    for text in ("Él und, x9y zwölf", "a", "ab cd"):
        assert (language_id.subwords(text) == plain_subwords(text)).all()


def plain_kt(a, b):
    p = 1.0
    for i in range(a):
        p *= (i + 0.5) / (i + 1)
    for j in range(b):
        p *= (j + 0.5) / (a + j + 1)
    return p


def plain_log10(texts, text, depth):
    """Context trees by recursion over every context, with exact small products."""
    counts = Counter()
    for t in texts:
        b = b"\xff" * depth + context_tree.lowered(t) + b"\xff"
        counts.update(b[i - depth : i + 1] for i in range(depth, len(b)))

    def decided(context, prefix, bits):
        n = [0, 0]
        for g, c in counts.items():
            if g[depth - len(context) : depth] == context and g[depth] >> (8 - bits) == prefix:
                n[g[depth] >> (7 - bits) & 1] += c
        return n

    @cache
    def weighted(context, prefix, bits):
        kt = plain_kt(*decided(context, prefix, bits))
        if len(context) == depth:
            return kt, 1.0
        product, longer = 1.0, len(context) + 1
        for g in {g[depth - longer : depth] for g in counts if g[depth - len(context) : depth] == context}:
            product *= weighted(g, prefix, bits)[0]
        return 0.5 * kt + 0.5 * product, 0.5 * kt / (0.5 * kt + 0.5 * product)

    b, total = b"\xff" * depth + context_tree.lowered(text) + b"\xff", 0.0
    for i in range(depth, len(b)):
        for bits in range(8):
            prefix, bit = b[i] >> (8 - bits), b[i] >> (7 - bits) & 1
            left, p = 1.0, 0.0
            for d in range(depth + 1):
                context = b[i - d : i]
                n = decided(context, prefix, bits)
                own = weighted(context, prefix, bits)[1]
                p += left * own * (n[bit] + 0.5) / (sum(n) + 1)
                left *= 1 - own
            total += math.log10(p)
    return total


@pytest.mark.parametrize("depth, head", [(3, 1 << 22), (4, 1 << 22), (4, 8), (5, 1)])
def test_context_tree_equals_recursion(spark, monkeypatch, depth, head):
    monkeypatch.setattr(context_tree, "HEAD_GRAMS", head)
    monkeypatch.setattr(context_tree, "CHUNK", 5)
    train, held = ["Abra cab", "abra", None, "zé"], ["bra abra kadabra", "", "q", None]
    rows = [(i, t) for i, t in enumerate(train + held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = context_tree.score_documents(docs, F.col("doc_id") >= len(train), depth=depth)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows)
    words = Counter(w for t in train for w in [*context_tree.lowered(t).split(), None])
    n, v = sum(words.values()), len(words)
    for i, t in rows:
        assert got[i].score == pytest.approx(plain_log10(train, t, depth), rel=1e-5)
        tokens = [*context_tree.lowered(t).split(), None]
        assert (got[i].n_tokens, got[i].train_tokens) == (len(tokens), n)
        assert got[i].n_known == sum(words[w] > 0 for w in tokens)
        assert got[i].base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))


def test_context_tree_without_training(spark):
    docs = spark.createDataFrame([(None, "ab"), (1, "é")], "doc_id long, text string")
    got = context_tree.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert sorted(r.score for r in got) == pytest.approx([-24 * math.log10(2)] * 2)
    with pytest.raises(ValueError, match="depth"):
        context_tree.score_documents(docs, F.lit(False), depth=2)


def test_context_tree_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(0, "Lorem ipsum " * 250_000), (1, "lorem ipsum")], "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.score_documents(docs, F.col("doc_id") == 1).collect()}
    assert got[0].n_tokens == 500_001 and got[0].bits_per_byte < 0.01


def test_rare_words_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "HEAD", 4)
    docs = spark.createDataFrame([(0, "a a a a b c"), (1, "a b d d")], "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.score_documents(docs, F.col("doc_id") == 1).collect()}
    assert got[1].n_known == 3 and got[1].train_tokens == 7
    want = sum(math.log10((c + 0.5) / (7 + 0.5 * 5)) for c in (4, 1, 0, 0, 1))
    assert got[1].base_score == pytest.approx(want)
    assert context_tree.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_log_gamma():
    assert np.allclose(context_tree.log_gamma(np.array([0.5, 1, 3.5, 900.5])), [math.lgamma(x) for x in (0.5, 1, 3.5, 900.5)])


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_hash_table_finds_its_keys_alone(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 3 * n + 1, n)) * 256
    values = np.arange(len(keys), dtype=np.float32)
    wanted = np.arange(0, 256 * (3 * n + 2), 64)
    hit, got = context_tree.from_table(*context_tree.hash_table(keys, values), wanted)
    assert (hit == np.isin(wanted, keys)).all()
    assert (got == np.searchsorted(keys, wanted[hit])).all()
