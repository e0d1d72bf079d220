"""Text functions, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
URI_PREFIX = "<http://dbpedia.org/resource/"
LABEL_DROP_PATTERN = "[^a-z0-9 ]"
TERMINATOR_PATTERN = r" \.$"
TOKEN_SPLIT_PATTERN = r"[^\p{L}\p{M}\p{N}]+"


def strip_terminator(line: Column) -> Column:
    """Drop the `` .`` that ends an N-Triples statement."""
    return F.regexp_replace(line, TERMINATOR_PATTERN, "")


def normalize_label(value: Column) -> Column:
    """Lower case, ASCII letters, digits and inner blanks only."""
    return F.trim(F.regexp_replace(F.lower(value), LABEL_DROP_PATTERN, ""))


def tokens(text: Column) -> Column:
    """Distinct non-empty word tokens, of letters and digits of any script, of a text."""
    words = F.split(F.lower(text), TOKEN_SPLIT_PATTERN)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _unescape(value: Column) -> Column:
    """Resolve backslash escapes by reading the value as a JSON string."""
    single = F.replace(value, F.lit("\\\\"), F.lit("\\"))
    quoted = F.replace(F.replace(single, F.lit('\\"'), F.lit('"')), F.lit('"'), F.lit("\\u0022"))
    parsed = F.get_json_object(F.concat(F.lit('{"v":"'), quoted, F.lit('"}')), "$.v")
    return F.when(F.contains(value, F.lit("\\")), F.coalesce(parsed, single)).otherwise(value)


def uri_encode(uri: Column, prefix: str = URI_PREFIX) -> Column:
    """Percent-encode the last path segment of URIs that start with ``prefix``.

    The URI is written ``<...>``; a segment that already holds a ``%`` and a
    URI with another prefix stay as they are.
    """
    head = F.regexp_extract(uri, r"(?s)^(.*/)", 1)
    segment = F.substr(uri, F.length(head) + 1, F.length(uri) - F.length(head) - 1)
    encoded = F.concat(head, F.url_encode(_unescape(segment)), F.lit(">"))
    touch = F.startswith(uri, F.lit(prefix)) & ~F.contains(segment, F.lit("%"))
    return F.when(touch, encoded).otherwise(uri)
