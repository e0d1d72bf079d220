"""Packing of token sequences by best-two-fit.

Texts are tokenised in Arrow batches and cut to pieces of at most ``length``
ids; only the numbers of a piece (ids, start, length, checksum) go on.  Full
pieces fill a sequence alone.  The others are dealt by hash (or, for documents in
a given order, as consecutive runs of it) into groups of a bounded number of ids,
and each group is packed by itself:

* greedy: open a sequence with the longest piece left, add the longest that fits;
* best two: let the smallest piece of the sequence go if two unpacked pieces
  together fill its place and the gap better; take the pair that fills most.

A group holds thousands of sequences, so what its last open sequence leaves
empty does not count.  A group needs memory for the lengths of its pieces only.

Defined cases: a null text is empty and gives one piece with the end id alone;
repeated rows (and null ids) are packed one by one; a text longer than a
sequence has its shorter piece first; ties go to the smaller id and piece; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import ordered, running_totals
from linkloom.runtime import materialize

LENGTH = 2_048
END_ID = 0
#: Ids in one packing group, about.
GROUP_IDS = 8_000_000
PIECES = "piece int, start long, length long, ids_crc32 long"
#: Runs of this length are left to the slower tokenizer, whose merges stay linear.
LONG_RUN = re.compile(r"\S{20000}|\s{20000}")


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Text to the ids of the tokenizer file, without added special tokens.

    The rank file of the same vocabulary gives the same ids several times
    faster; texts with extreme runs or with a literal of one of the added
    tokens of the tokenizer file go to that file itself.
    """
    import public_tokenizers as files
    import tiktoken

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(files.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(files.path(f"{name}.json"), encoding="utf-8") as given:
        added = [token["content"] for token in json.load(given)["added_tokens"]]
    slow: list[object] = []

    def encode(text: str) -> list[int]:
        if (len(text) < 20_000 or not LONG_RUN.search(text)) and not any(token in text for token in added):
            return fast.encode_ordinary(text)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(files.path(f"{name}.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids, the shorter one first."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))]


def _pieces(name: str, length: int, carried: Sequence[str] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in batches:
            texts, known = batch.column("text"), {}
            at, rows = [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                if (found := known.get(text)) is None:
                    ids = np.array([*encode(text), END_ID], "<u4")
                    found = [
                        (k, start, n, zlib.crc32(ids[start : start + n].tobytes()))
                        for k, (start, n) in enumerate(cut(len(ids), length))
                    ]
                    known[text] = found
                at.extend([i] * len(found))
                rows.extend(found)
            piece, start, size, crc = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    *(batch.column(c).take(pa.array(at, pa.int64())) for c in carried),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *carried],
            )

    return pieces


def token_pieces(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    tokenizer: str = "byte_bpe_50k",
    order: Sequence[str] = (),
) -> DataFrame:
    """A written table of the pieces of all documents: doc_id, piece, start, length, ids_crc32.

    The columns of ``order`` are carried along as _order0, _order1 and so on.
    """
    carried = [f"_order{i}" for i in range(len(order))]
    given = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        *(F.col(c).alias(name) for c, name in zip(order, carried, strict=True)),
    )
    kinds = dict(given.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in carried)
    schema = f"doc_id {kinds['doc_id']}, {PIECES}{more}"
    return materialize(given.mapInArrow(_pieces(tokenizer, length, carried), schema), "pieces")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece.

    Pieces of one length are alike, so the search works on counts by length;
    within a length they are taken in the given order.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    taken = np.concatenate([[0], np.cumsum(counts)])[:-1]
    sizes = np.arange(capacity + 1)
    # longest[g]: the longest length left that is at most g (0: none)
    longest = np.maximum.accumulate(np.where(counts > 0, sizes, 0))
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            end = n
            while end <= capacity and longest[end] == n:
                end = min(capacity + 1, end + 64)
            block = longest[n:end]
            block[block == n] = longest[n - 1]

    def give(n: int) -> None:
        counts[n] += 1
        if counts[n] == 1:
            block = longest[n:]
            block[block < n] = n

    number = 0
    while longest[capacity]:
        filled, gap = [], capacity
        while n := int(longest[gap]):
            take(n)
            filled.append(n)
            gap -= n
        if gap and len(filled) > 1 and longest[capacity]:
            least = filled[-1]
            room = gap + least
            first = sizes[1:room][counts[1:room] > 0]
            if len(first):
                second = longest[room - first]
                alike = (second == first) & (counts[first] < 2)
                if alike.any():  # the only piece of its length cannot be both
                    second = np.where(alike, longest[np.maximum(first - 1, 0)], second)
                both = np.where(second > 0, first + second, 0)
                best = int(both.argmax())
                if both[best] > least:
                    filled.pop()
                    take(int(first[best]))
                    take(int(second[best]))
                    filled += [int(first[best]), int(second[best])]
                    give(least)
        at = 0
        for n in filled:
            row = order[taken[n]]
            taken[n] += 1
            sequence[row], offset[row] = number, at
            at += n
        number += 1
    return sequence, offset


def _packed(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_two_fit(group["length"].to_numpy(), capacity)
        number = (group["pack"].to_numpy() << 32) + sequence
        return group.drop_columns(["pack"]).append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset)
        )

    return packed


def _packed_in_order(capacity: int) -> Callable[[pa.Table], pa.Table]:
    """As ``_packed``; equal lengths go, and sequences are numbered, by the first place."""

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("_before")
        sequence, offset = best_two_fit(group["length"].to_numpy(), capacity)
        _, first, inverse = np.unique(sequence, return_index=True, return_inverse=True)
        number = (group["pack"].to_numpy() << 32) + np.argsort(np.argsort(first))[inverse]
        return group.drop_columns(["pack", "_before"]).append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset)
        )

    return packed


def pack_pieces(
    pieces: DataFrame, *, length: int = LENGTH, group_ids: int = GROUP_IDS, order: Sequence[str] = ()
) -> DataFrame:
    """The pieces with sequence_id and offset.

    With ``order`` (columns of the pieces) a group is a run of consecutive
    pieces in that order, and sequence_id follows it; otherwise pieces are dealt
    to the groups by hash.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / group_ids))
    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {PIECES}, sequence_id long, offset long"
    if order:
        keys = [F.col(c) for c in (*order, "doc_id", "piece", "ids_crc32")]
        placed = ordered(pieces.withColumn("_all", F.lit(0)), keys, "piece-order").drop(*order)
        lined = running_totals(placed, "_all", "length", "_before").drop("_all")
        runs = lined.withColumn("pack", F.expr(f"_before div {max(1, -(-total // groups))}"))
        return runs.groupBy("pack").applyInArrow(_packed_in_order(length), schema)
    dealt = pieces.withColumn(
        "pack", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long")
    )
    return dealt.groupBy("pack").applyInArrow(_packed(length), schema)


def pack_documents(
    docs: DataFrame, *, length: int = LENGTH, group_ids: int = GROUP_IDS, order: Sequence[str] = (), **options: str
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``order`` names the columns of ``docs`` whose order the sequences follow.
    """
    pieces = token_pieces(docs, length=length, order=order, **options)
    carried = [f"_order{i}" for i in range(len(order))]
    return pack_pieces(pieces, length=length, group_ids=group_ids, order=carried)
