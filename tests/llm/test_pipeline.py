"""The pipeline against a plain version of its stages on a small table."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from linkloom.llm import packing


def made_rows(seed=3):
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    texts = [words(rng.choice([25, 60, 200])) for _ in range(24)]
    rows = [" ".join(t) for t in texts]
    rows += ["  ".join(t) for t in texts[:4]]  # equal but for white space
    for t in texts[4:10]:  # one word of 200 or so differs
        near = list(t)
        near[-1] = "changed"
        rows.append("\n".join(near))
    rows += ["too short", "", None, " ".join(["again and again the very same eight words"] * 10)]
    rows += [" ".join(words(4000))]
    rng.shuffle(rows)
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]


def passes(text):
    words = (text or "").split()
    spans = defaultdict(list)
    for i in range(len(words) - 7):
        spans[tuple(words[i : i + 8])].append(i)
    again = {k for at in spans.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words) >= 20 and 100 * len(again) <= 30 * len(words)


def survivors(rows):
    left = [(i, t) for i, t, *_ in rows if passes(t)]
    best = {}
    for i, t in left:
        plain = re.sub(r"[\x20\x09-\x0D]+", "", t)
        best[plain] = min(best.get(plain, (0, i + 1, t)), (-len(t), i, t))
    left = sorted((i, t) for _, i, t in best.values())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in left}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: t for i, t in left if label[i] == i}


def test_equals_a_plain_version(spark, tmp_path):
    rows = made_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = survivors(rows)
    assert len(want) < len([r for r in rows if passes(r[1])])
    assert {r.doc_id for r in got} == set(want)
    encode = packing.encoder()
    for i, text in want.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == len(encode(text)) + 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= packing.LENGTH
