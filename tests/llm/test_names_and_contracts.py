"""Input columns of any name, tokenizer and letter contracts, null ids, rare-shingle pairs."""

import math
import random

import numpy as np
import pytest
from linkloom.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality_rules
from pyspark.sql import functions as F

NAMES = [
    "_id", "_mark", "_text_mark", "_failed", "_host", "_slot", "_gone", "_nth", "_n", "_start", "_from", "_row", "mix_slot",
    "row", "id", "mark", "failed", "rejected", "gone", "slot", "source_offset", "stay", "nth", "from", "_part", "_at", "_bytes",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + "\nsame line of several words here", f"s{i % 3}") for i in range(20)]
    rows += [(50, rows[3][1], "s0"), (50, rows[3][1], "s0"), (None, rows[4][1], None)]
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES))


@pytest.mark.parametrize(
    "stage,kept",
    [
        (quality_rules.keep_good_documents, 23),
        (exact_dedup.drop_exact_copies, 20),
        (near_dedup.drop_near_copies, 20),
        (lambda d: mixing.in_mixed_order(d), 23),
        (line_dedup.remove_repeated_lines, 23),
    ],
)
def test_columns_of_any_name(docs, stage, kept):
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == kept
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)


def test_places_replace_columns(docs):
    out = mixing.in_mixed_order(docs, places=("mix_slot", "mix_offset"))
    assert out.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_slot", "mix_offset"]
    assert len({(r.mix_slot, r.mix_offset) for r in out.collect()}) == 22  # two rows are one unit


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>" * 3, "x" * 20_001 + " y", " " * 20_500 + "é", "word " * 9_000, "½² Ⅷ ́a"):
        assert list(encode(text)) == plain.encode(text, add_special_tokens=False).ids


def test_letters_are_category_l(spark):
    assert not any(language_id.subwords(t).any() for t in ("½²", "Ⅷ", "12 34", "́", "", None, "_-"))
    assert language_id.subwords("हिन्दी").any() and language_id.subwords("é").any()
    df = spark.createDataFrame([(None, f"some words {i}", lang) for i in range(60) for lang in ("aa", "bb")] + [(1, "Ⅷ", "aa")], "doc_id long, text string, lang string")
    model = language_id.fit(df, per_language=5)
    assert model.languages == ["aa", "bb"]
    got = language_id.predict(df, model).filter("doc_id = 1").first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_a_rare_element_is_shared():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, near_dedup.RARITY)
    for _ in range(300):
        base = rng.integers(-(2**62), 2**62, rng.integers(1, 60))
        a = np.unique(np.concatenate([base, rng.integers(-(2**62), 2**62, rng.integers(0, 8))]))
        b = np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(-(2**62), 2**62, rng.integers(0, 8))]))
        if len(b) and jaccard(set(a), set(b)) >= 0.8:
            a, b = sorted((a, b), key=len)
            first = near_dedup.rarest(a, counts, 0.8)[: len(a) - math.ceil(1.6 / 1.8 * len(a) - 1e-9) + 1]
            assert set(first) & set(near_dedup.rarest(b, counts, 0.8))


def test_unlike_texts_of_a_hot_template_do_not_meet(spark):
    """Half of every text is common to all; pairs of a few are near copies."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rows, label = [], {}
    for i in range(120):
        own = [f"o{i}_{j}" for j in range(60)]
        rows.append((2 * i, " ".join(common + own)))
        own[30] = "changed"
        rows.append((2 * i + 1, " ".join(common + own)))
        label[2 * i] = label[2 * i + 1] = 2 * i
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(df).collect()}
    assert got == label
    texts = spark.createDataFrame([(str(d).encode(), str(d).encode()) for d, _ in rows], "words binary, label binary")

    def shingled(text):
        return near_dedup.shingles(text.encode().split(), near_dedup.Words())[0].view(np.int64).tolist()

    sets = spark.createDataFrame([(str(d).encode(), shingled(t)) for d, t in rows], "words binary, shingles array<long>")
    met = near_dedup._rare_pairs(texts, sets, 0.8).collect()
    assert 120 <= len(met) <= 130
    assert {int(r.a) // 2 for r in met if int(r.a) // 2 == int(r.b) // 2} == set(range(120))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    for stage in (quality_rules.keep_good_documents, exact_dedup.drop_exact_copies, near_dedup.drop_near_copies, mixing.in_mixed_order, line_dedup.remove_repeated_lines, packing.pack_documents):
        assert stage(none).count() == 0
    assert none.select(F.count("*")).first()[0] == 0
