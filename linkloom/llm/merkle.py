"""A Merkle manifest of a table, built and proved by time-forward processing.

Each row is a leaf.  The leaves of one source ascend by id; every ARITY
consecutive nodes become one node until one is left, the subroot; the subroots
in the order of their sources make a tree of the same kind, whose top is the
root.  A node is labelled by (level, index).

A node sends its digest forward to its parent through a priority queue ordered
by the label of the receiver; a node is computed when its label comes up, as
all its children have smaller labels.  The queue is external: a task holds only
the part of it that belongs to one chunk of ARITY ** ROUND neighbouring nodes,
and what leaves a chunk is a row that Spark's sorted shuffle delivers to the
chunk of the next round.  ROUND levels are climbed per round, so the number of
rounds is the logarithm of the largest source.  The reversed sweep takes the
labels in falling order and sends to each child the runs of siblings above it;
at the leaves these give the proof and fold a (tampered) leaf to the root.

Texts are hashed where they are read and never move; the queues carry digests.
No task sees more than ARITY ** ROUND leaves of a group, however large a source.

Defined cases: a null column enters a leaf as ``-``; a null source is a source
of its own and comes first; null ids come first in their source; rows that tie
in source and id are ordered by their leaf, so that equal rows get proofs of
their own.  Empty and very long texts are hashed like others.  An empty table
gives an empty result.  Other columns do not enter and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.window import Window

from linkloom.llm.shared import crc_modulo, ordered
from linkloom.runtime import materialize

ARITY = 16
ROUND = 2
CHUNK = ARITY**ROUND
#: Which ids are tampered with, and the columns of a leaf in their order.
TAMPERED_PART = 5
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Message = tuple[tuple[int, int], int, str]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climb(queue: list[Message], top: int) -> Iterator[tuple[int, int, str, str]]:
    """Forward sweep: ``(level, index, digest, run)`` of the nodes up to level ``top``.

    ``queue`` holds messages (label of the receiver, place of the child, digest).
    """
    heapify(queue)
    while queue and queue[0][0][0] <= top:
        label, run = queue[0][0], ""
        while queue and queue[0][0] == label:
            run += heappop(queue)[2]
        made = digest(run)
        yield *label, made, run
        heappush(queue, ((label[0] + 1, label[1] // ARITY), label[1] % ARITY, made))


def descend(
    nodes: dict[tuple[int, int], str], tops: list[tuple[int, int]], above: tuple[str, ...], low: int
) -> dict[int, tuple[str, ...]]:
    """Reversed sweep: for every node of level ``low`` the runs it stands in, lowest first.

    nodes -- the run (digests of the children) of every node of the chunk
    tops -- its highest nodes; they receive ``above``
    """
    queue = [((-level, -index), above) for level, index in tops]
    heapify(queue)
    delivered: dict[int, tuple[str, ...]] = {}
    while queue:
        (level, index), runs = heappop(queue)
        level, index = -level, -index
        if level == low:
            delivered[index] = runs
            continue
        run = nodes[level, index]
        for child in range(len(run) // 64):
            heappush(queue, ((1 - level, -(index * ARITY + child)), (run, *runs)))
    return delivered


def siblings(run: str, place: int) -> str:
    return run[: 64 * place] + run[64 * place + 64 :]


def fold(leaf: str, runs: tuple[str, ...], places: list[int]) -> str:
    """The top that a leaf gives with the siblings of its runs."""
    for run, place in zip(runs, places, strict=True):
        leaf = digest(run[: 64 * place] + leaf + run[64 * place + 64 :])
    return leaf


def places_of(index: int, levels: int) -> list[int]:
    return [index // ARITY**level % ARITY for level in range(levels)]


def leaf_text(columns: list[Column]) -> Column:
    """The columns as one text: ``-`` for null, else byte count, colon, value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(sized))
    return F.concat(*parts)


def leaves(docs: DataFrame, columns: tuple[str, ...] = LEAF_COLUMNS) -> DataFrame:
    """``doc_id, grp, leaf, tampered`` of every row; ``grp`` orders like the source, null first.

    columns -- the names of id, source, language, size and text in ``docs``
    """
    doc_id, source, *rest, text = (F.col(c) for c in columns)
    lowered = F.translate(text, ascii_uppercase, ascii_lowercase)
    hashed = F.sha2(leaf_text([doc_id, source, *rest, text]).cast("binary"), 256)
    changed = F.sha2(leaf_text([doc_id, source, *rest, lowered]).cast("binary"), 256)
    return docs.select(
        doc_id.alias("doc_id"),
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string"))).alias("grp"),
        hashed.alias("leaf"),
        F.when(crc_modulo(doc_id, TAMPERED_PART) == 0, changed).alias("tampered"),
    )


def _numbered(rows: DataFrame, group: list[str], keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx`` from 0 inside the group in the order of ``keys``, the group's ``size``, and ``chunk``.

    Range partitions cut a hot group; per (group, partition) only a count is
    carried on.
    """
    placed = ordered(rows, [F.col(k).asc_nulls_first() for k in group + keys], name)
    inside = placed.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = inside.select(
        "_part",
        *group,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"),
    )
    return (
        placed.join(carried, ["_part", *group])
        .withColumn("idx", F.col("_at") + F.col("_shift"))
        .withColumn("chunk", F.floor(F.col("idx") / CHUNK))
        .drop("_part", "_at", "_shift")
    )


NODE = {
    "grp": "string", "size": "long", "chunk": "long", "level": "int", "idx": "long", "digest": "string", "run": "string",
}
#: What a chunk receives from above: the runs over its top and the places in them, lowest first.
MESSAGE = {
    "grp": "string", "size": "long", "chunk": "long", "runs": "array<string>", "places": "array<int>",
    "subroot": "string", "root": "string",
}
PROOF = {"subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def _table(fields: dict[str, str], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(c, ARROW[kind]) for c, kind in zip(columns, fields.values(), strict=True)]
    return pa.Table.from_arrays(arrays, names=list(fields))


def _climbed(level: int) -> Callable[[pa.Table], pa.Table]:
    def climbed(rows: pa.Table) -> pa.Table:
        grp, size, chunk = (rows.column(c)[0].as_py() for c in ("grp", "size", "chunk"))
        queue = [
            ((level + 1, i // ARITY), i % ARITY, d)
            for i, d in zip(rows.column("idx").to_pylist(), rows.column("digest").to_pylist(), strict=True)
        ]
        made = climb(queue, min(level + ROUND, height(size)))
        return _table(NODE, [(grp, size, chunk, *node) for node in made])

    return climbed


def forward(base: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Climb from ``base`` (grp, size, idx, chunk, digest) of groups up to ``largest``.

    Returns the nodes made in each round and ``grp, size, digest`` of the tops.
    """
    rounds: list[DataFrame] = []
    tops = base.filter("size = 1").select("grp", "size", "digest")
    below = base.filter("size > 1").select("grp", "size", "idx", "chunk", "digest")
    for level in range(0, height(largest), ROUND):
        made = materialize(below.groupBy("grp", "chunk").applyInArrow(_climbed(level), _ddl(NODE)), "merkle-nodes")
        rounds.append(made)
        alone = F.col("size") <= F.pow(F.lit(float(ARITY)), F.col("level"))
        tops = tops.unionByName(made.filter(alone).select("grp", "size", "digest"))
        below = made.filter((F.col("level") == level + ROUND) & ~alone).select(
            "grp", "size", "idx", F.floor(F.col("idx") / CHUNK).alias("chunk"), "digest"
        )
    return rounds, tops


def _runs_above(received: pa.Table, low: int) -> tuple[dict, dict[int, tuple[str, ...]]]:
    """The message to a chunk, and the runs above each of its nodes of level ``low``.

    ``received`` has one row with the message and one per node of the chunk.
    """
    rows = received.to_pylist()
    message = next(r for r in rows if r["run"] is None)
    nodes = {(r["level"], r["idx"]): r["run"] for r in rows if r["run"] is not None}
    if not nodes:  # a group of one leaf
        return message, {0: tuple(message["runs"])}
    highest = max(level for level, _ in nodes)
    tops = [label for label in nodes if label[0] == highest]
    return message, descend(nodes, tops, tuple(message["runs"]), low)


def _received(nodes: DataFrame | None, sent: DataFrame) -> DataFrame:
    """Messages and nodes of the chunks in one table, for one shuffle by chunk."""
    if nodes is None:
        return sent.withColumns({c: F.lit(None).cast(t) for c, t in (("level", "int"), ("idx", "long"), ("run", "string"))})
    made = nodes.select("grp", "size", "chunk", "level", "idx", "run")
    return made.unionByName(sent, allowMissingColumns=True)


def _delivered(level: int) -> Callable[[pa.Table], pa.Table]:
    def delivered(received: pa.Table) -> pa.Table:
        message, above = _runs_above(received, level)
        rest = (message["places"], message["subroot"], message["root"])
        return _table(MESSAGE, [(message["grp"], message["size"], index, list(runs), *rest) for index, runs in above.items()])

    return delivered


def backward(rounds: list[DataFrame], sent: DataFrame) -> DataFrame:
    """Messages to the chunks of leaves, from one message ``sent`` to the top of every group."""
    for number in range(len(rounds) - 1, 0, -1):
        high = F.col("size") > CHUNK**number
        received = _received(rounds[number], sent.filter(high))
        made = received.groupBy("grp", "chunk").applyInArrow(_delivered(number * ROUND), _ddl(MESSAGE))
        sent = materialize(sent.filter(~high).unionByName(made), "merkle-messages")
    return sent


def _path(message: dict, index: int, above: dict[int, tuple[str, ...]]) -> tuple[tuple[str, ...], list[int]]:
    """The runs above a leaf and its places in them; upper places come with the message."""
    runs = above[index]
    return runs, places_of(index, len(runs) - len(message["places"])) + message["places"]


def _addressed(rows: pa.Table, received: pa.Table) -> pa.Table:
    """Messages to the tops of the sources whose subroots are in one chunk."""
    message, above = _runs_above(received, 0)
    out = []
    for row in rows.to_pylist():
        runs, places = _path(message, row["idx"], above)
        out.append((row["source_grp"], row["source_size"], 0, list(runs), places, row["digest"], message["root"]))
    return _table(MESSAGE, out)


def _proved(rows: pa.Table, received: pa.Table) -> pa.Table:
    """Proof and folded root of the leaves of one chunk."""
    message, above = _runs_above(received, 0)
    proofs, folded = [], []
    for index, leaf, tampered in zip(*(rows.column(c).to_pylist() for c in ("idx", "leaf", "tampered")), strict=True):
        runs, places = _path(message, index, above)
        proofs.append(digest("".join(siblings(r, p) for r, p in zip(runs, places, strict=True))))
        folded.append(fold(tampered or leaf, runs, places))
    subroot, root = message["subroot"], message["root"]
    made = _table(PROOF, [(subroot, root, p, f, f == root) for p, f in zip(proofs, folded, strict=True)])
    out = rows.select(["doc_id", "grp", "leaf"])
    for name in PROOF:
        out = out.append_column(name, made.column(name))
    return out


def _by_chunk(rows: DataFrame, rounds: list[DataFrame], sent: DataFrame) -> PandasCogroupedOps:
    received = _received(rounds[0] if rounds else None, sent)
    return rows.groupBy("grp", "chunk").cogroup(received.groupBy("grp", "chunk"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = LEAF_COLUMNS) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is the digest of all siblings from the leaf upwards.  Where the
    leaf was tampered with, the changed leaf is folded; it verifies only if the
    text did not change.
    """
    hashed = materialize(leaves(docs, columns).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    base = materialize(_numbered(hashed, ["grp"], ["doc_id", "leaf", "row"], "merkle-order"), "merkle-base")
    digests = base.select("grp", "size", "idx", "chunk", F.col("leaf").alias("digest"))
    rounds, tops = forward(digests, _largest(base))

    # the subroots are the leaves of one more group
    subroots = tops.select(
        F.lit("").alias("grp"), F.col("grp").alias("source_grp"), F.col("size").alias("source_size"), "digest"
    )
    upper = materialize(
        _numbered(materialize(subroots, "merkle-subroots"), ["grp"], ["source_grp"], "merkle-sources"), "merkle-upper"
    )
    upper_rounds, root = forward(upper, _largest(upper))
    value = root.select("digest").first()
    start = upper.filter("idx = 0").select(
        "grp",
        "size",
        "chunk",
        F.array().cast("array<string>").alias("runs"),
        F.array().cast("array<int>").alias("places"),
        F.lit("").alias("subroot"),
        F.lit(value[0] if value else None).cast("string").alias("root"),
    )
    sent = backward(upper_rounds, start)
    to_sources = _by_chunk(upper.drop("size"), upper_rounds, sent).applyInArrow(_addressed, _ddl(MESSAGE))
    sent = backward(rounds, materialize(to_sources, "merkle-messages"))

    schema = f"doc_id {dict(base.dtypes)['doc_id']}, grp string, leaf string, {_ddl(PROOF)}"
    rows = base.select("doc_id", "grp", "chunk", "idx", "leaf", "tampered")
    proved = _by_chunk(rows, rounds, sent).applyInArrow(_proved, schema)
    source = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
    return proved.select(
        "doc_id", source.alias("source"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def _largest(base: DataFrame) -> int:
    return base.agg(F.max("size")).first()[0] or 0
