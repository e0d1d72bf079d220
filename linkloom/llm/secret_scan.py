"""Secret scan with multipart credential linking.

Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they stand.
Weak kinds say little alone: a 40-character ``secret``, a user ``identifier``, an
``endpoint``.  A weak candidate is reported only when complementary parts lie
within its scope, ``scope`` code points to either side:

* a ``secret`` needs an access identifier (``access`` or ``identifier``);
* an ``identifier`` needs a secret part (``assign``, ``hex`` or ``secret``);
* an ``endpoint`` needs both.

Matches come from ``regexp_extract_all``, their places from the lengths of the
pieces that ``split`` leaves between them.  Parts are then rows; the interval
join "any part of that role within my scope" is answered by the running latest
end and earliest start of each role, so no pairs of parts are made and a text
full of candidates costs its own length.  Only texts with candidates move.

Defined cases: a null text counts as empty and gets zero counts; repeated rows
are scanned one by one (each row has its own number in a written table); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.runtime import materialize

#: The patterns of the strong kinds, in their order.
STRONG = {
    "assign": r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    # a single "=" before it assigns; base64 padding stands at the end only
    "secret": r"(?<![A-Za-z0-9/+_-]|[=+/]=)[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])",
    "identifier": r"(?<![A-Za-z0-9])(?=[UuLlCcAa])(?i:user(?:name|_?id)?|login|client_?id|access_?key_?id|account)"
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{3,}""",
    "endpoint": r"(?<![A-Za-z0-9])(?:(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://"
    r"""[^\x20\x09-\x0D"'<>]+|[a-z0-9][a-z0-9.-]*\.amazonaws\.com)""",
}
KINDS = [*STRONG, *WEAK]
#: Length of the value of an ``assign`` match.
MIN_VALUE = 6
SCOPE = 300

ROLES = {"id": ["access", "identifier"], "secret": ["assign", "hex", "secret"]}
NEEDS = {"secret": ["id"], "identifier": ["secret"], "endpoint": ["id", "secret"]}


def _found(text: Column, pattern: str) -> Column:
    """The matches of one kind and the lengths of the pieces around them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.struct(matches.alias("matches"), pieces.alias("gaps")))


def candidate_parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: row, doc_id, and for each kind its matches or null."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = {**STRONG, **WEAK}
    return materialize(
        given.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            *(_found(F.col("text"), pattern).alias(kind) for kind, pattern in found.items()),
        ),
        "secret-parts",
    )


def part_spans(parts: DataFrame) -> DataFrame:
    """One row per match: row, rank of its kind, kind, start, end (code points)."""

    def exploded(rank: int, kind: str) -> DataFrame:
        return parts.filter(F.col(kind).isNotNull()).select(
            "row",
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            F.posexplode(f"{kind}.matches").alias("at", "match"),
            F.col(f"{kind}.gaps").alias("gaps"),
        )

    rows = reduce(DataFrame.unionByName, [exploded(i, k) for i, k in enumerate(KINDS)])
    step = rows.withColumn("gap", F.col("gaps")[F.col("at")]).drop("gaps")
    earlier = (
        Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ended = step.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(earlier))
    value = F.length(F.regexp_extract("match", STRONG["assign"], 1))
    return ended.filter((F.col("kind") != "assign") | (value >= MIN_VALUE)).select(
        "row", "rank", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match"
    )


def linked_spans(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong spans, and the weak ones whose complementary parts are near."""
    # a lower-case hex run is already a strong span
    once = spans.filter((F.col("kind") != "secret") | ~F.col("match").rlike("^[0-9a-f]+$"))
    back = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("row").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = once
    for role, kinds in ROLES.items():
        of_role = F.col("kind").isin(kinds)
        near = near.withColumn(
            f"near_{role}",
            F.coalesce(F.max(F.when(of_role, F.col("end"))).over(back) >= F.col("start") - scope, F.lit(False))
            | F.coalesce(F.min(F.when(of_role, F.col("start"))).over(ahead) <= F.col("end") + scope, F.lit(False)),
        )
    allowed = F.col("kind").isin(list(STRONG))
    for kind, roles in NEEDS.items():
        complete = reduce(lambda a, b: a & b, [F.col(f"near_{r}") for r in roles])
        allowed = allowed | ((F.col("kind") == kind) & complete)
    return near.filter(allowed).drop(*(f"near_{r}" for r in ROLES))


def scan_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per document: doc_id, counts of the strong kinds, and ``found``.

    ``found`` is an array of (start, rank, kind, end, match), in order.
    """
    parts = candidate_parts(docs, doc_id, text)
    spans = linked_spans(part_spans(parts), scope)
    by_row = spans.groupBy("row").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in STRONG),
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "match"))).alias("found"),
    )
    return (
        parts.select("row", "doc_id")
        .join(by_row, "row", "left")
        .select(
            "doc_id",
            *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in STRONG),
            F.coalesce("found", F.array().cast(by_row.schema["found"].dataType)).alias("found"),
        )
    )


def span_text(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
