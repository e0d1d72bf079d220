"""The mix decides which pieces share a group, and the order of the sequences."""

import random
from collections import defaultdict

import corpus_pipeline
from linkloom.llm import packing


def test_groups_are_consecutive_runs(spark):
    order = random.Random(1).sample(range(300), 300)
    rows = [(i, "ab " * (1 + i % 9), at) for i, at in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long")
    got = packing.pack_documents(docs, length=32, group_ids=500, order=["at"]).collect()
    assert sorted({r.doc_id for r in got}) == list(range(300))
    groups, firsts, ids = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32].append(order[r.doc_id])
        firsts[r.sequence_id].append(order[r.doc_id])
        ids[r.sequence_id >> 32] += r.length
    assert len(groups) > 3 and max(ids.values()) < 600
    runs = [sorted(groups[g]) for g in sorted(groups)]
    assert [at for run in runs for at in run] == sorted(at for run in runs for at in run)
    numbered = [min(firsts[s]) for s in sorted(firsts)]
    assert numbered == sorted(numbered)


def test_targets_reach_the_sequences(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(90_000)}" for _ in range(1_500))
        rows.append((i, text, "en", f"src{i % 2}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )

    def mean_place(targets):
        monkeypatch.setattr(corpus_pipeline, "TARGETS", targets)
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in got} == set(range(60))
        places = defaultdict(list)
        for r in got:
            places[f"src{r.doc_id % 2}"].append(r.sequence_id)
        return {k: sum(v) / len(v) for k, v in places.items()}

    first, second = mean_place({"src0": 0.9, "src1": 0.1}), mean_place({"src0": 0.1, "src1": 0.9})
    assert first["src0"] < first["src1"]
    assert second["src0"] > second["src1"]
