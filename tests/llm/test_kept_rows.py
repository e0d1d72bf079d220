"""Rows that the decisions keep are all returned, also when they agree in id and text."""

from collections import Counter

from linkloom.llm import exact_dedup, near_dedup


def test_as_many_rows_stay_as_decisions_keep(spark):
    rows = [(None, None, 1), (None, None, 2), (None, "", 3), (2, None, 4), (2, None, 5), (4, " \n", 6), (4, " \n", 7)]
    rows += [(None, "a b c d e f", 8), (None, "a b c d e f", 9), (5, "u v w x y z", 10), (5, "u v w x y z", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    for groups, drop in (
        (near_dedup.near_groups, near_dedup.drop_near_copies),
        (exact_dedup.exact_groups, exact_dedup.drop_exact_copies),
    ):
        want = Counter((r.doc_id, r.mark) for r in groups(docs).collect() if r.kept)
        kept = drop(docs).collect()
        assert len(kept) == want.total() and len({r["size"] for r in kept}) == len(kept)
        assert Counter(r.doc_id for r in kept) == Counter(i for i, _ in want.elements())
    near = {r["size"] for r in near_dedup.drop_near_copies(docs).collect()}
    assert near >= {1, 2, 3, 4, 5, 6, 7} and len(near) == 9
