"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words.  Lines with equal sets fold into one; the
different sets are joined with themselves:

* words are ordered by rarity: by the count of their bucket among BUCKETS hashed
  buckets, then by hash.  Any total order keeps the join exact, and the table of
  bucket counts has a fixed size;
* prefix filter: sets of n words that reach the similarity t share a word among
  their first n - ceil(t n) + 1;
* length filter: t n <= m <= n / t; positional filter: the words after the
  shared one must suffice for the overlap;
* bitmap filter: sets that differ in d words differ in at most d of 64 parity
  bits, so pairs whose bits differ more than the overlap allows cannot match;
* the pairs left are compared on 256 such bits, which few but the matches pass,
  and then verified on all their words.

Only the rarest words of a line are kept.  The words of the lines that have
candidates are taken from their texts again, found by a hash of the text.

A line is removed when a line that matches it stands earlier (smaller doc_id,
then place), whether that one is itself removed or not.  Exact repeats never
form pairs, so a line with a third of all rows costs one group with partial
aggregation.  Words are told apart by 64-bit hashes.

Defined cases: a null text has one empty line; lines without words are never
removed or counted as matches; null ids come last; repeated rows are rows like
others, the later ones lose their lines; an empty table gives an empty result;
other columns are not read by ``line_matches`` and carried along by
``remove_repeated_lines``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.shared import free_name
from linkloom.runtime import materialize

SIMILARITY = 0.8
#: Bits of the number of a word's bucket.
BITS = 16
BUCKETS = 1 << BITS
#: White space that parts words, but for the space itself and the end of a line.
OTHER_SPACE = r"[\x09\x0B-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _plain(text: Column) -> Column:
    """The text with spaces for the other characters that part words, line ends apart."""
    # most texts have none of them, and looking for one is cheaper than the expression
    some = reduce(Column.__or__, (F.contains(text, F.lit(space)) for space in "\t\v\f\r"))
    return F.when(some, F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(text)


def _words(plain: Column) -> Column:
    """The words, with empty ones where spaces meet; by one character, for which Java takes no expression."""
    return F.split(plain, " ", -1)


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def word_order(texts: DataFrame, text: str = "text") -> Column:
    """The place of each word bucket by rarity, as one constant array of BUCKETS numbers."""
    counts = (
        texts.select(F.explode(_words(F.replace(_plain(F.col(text)), F.lit("\n"), F.lit(" ")))).alias("word"))
        .groupBy(_bucket(F.xxhash64("word")).alias("bucket"))
        .count()
        .collect()  # at most BUCKETS rows
    )
    found = {r["bucket"]: r["count"] for r in counts}
    place = [0] * BUCKETS
    for at, bucket in enumerate(sorted(range(BUCKETS), key=lambda b: (found.get(b, 0), b))):
        place[bucket] = at - BUCKETS // 2
    return F.split(F.lit(",".join(map(str, place))), ",").cast("array<long>")


def hashes_of(plain: Column) -> Column:
    """64-bit hashes of the different words of a line, in the order of the line."""
    return F.array_remove(F.array_distinct(F.transform(_words(plain), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def by_rarity(hashes: Column, order: Column) -> Column:
    """The hashes with the bucket number changed for the bucket's place, the rarest first."""

    def ranked(word: Column) -> Column:
        # never null, which Spark cannot know and would sort objects for
        place = F.coalesce(order[_bucket(word).cast("int")], F.lit(0).cast("long"))
        return F.shiftleft(place, 64 - BITS).bitwiseOR(F.shiftrightunsigned(word, BITS))

    return F.sort_array(F.transform(hashes, ranked))


def _parity(words: str, part: int | None = None) -> Column:
    """64 bits, each the parity of the number of words that fall on it; only of the words of that quarter, if named."""
    ours = "true" if part is None else f"(shiftrightunsigned(w, 6) & 3) = {part}"
    return F.expr(f"aggregate({words}, 0L, (bits, w) -> IF({ours}, bits ^ shiftleft(1L, cast(w & 63 as int)), bits))")


def _differ(bits: str) -> Column:
    """How many of these parity bits differ: at most as many as there are words that only one set has."""
    return F.bit_count(F.col(f"{bits}_a").bitwiseXOR(F.col(f"{bits}_b")))


def _key(value: Column) -> Column:
    """128 bits that tell values apart: two hashes of them."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(i), value)), 16, "0")) for i in range(2)))


def _needed(similarity: float) -> Column:
    """The words that sets of n_a and n_b words must share."""
    return F.ceil(similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9)


def head_of(similarity: float) -> Column:
    """32 bits of each of the rarest ``words`` of a set, as many as the prefix filter needs.

    Words that agree in these bits make candidates that the later filters drop.
    """
    size = F.size("words")
    prefix = size - F.ceil(similarity * size - 1e-9).cast("int") + 1
    low = F.lit((1 << 32) - 1)
    # a negative int is 2^32 less, so that no cast overflows
    return F.transform(
        F.slice("words", F.lit(1), prefix), lambda w: (w.bitwiseAND(low) - F.lit(1 << 31)).cast("int")
    )


def candidate_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ids of ``sets`` (id, n, bits, head) that pass the filters; every pair that matches is one."""
    heads = sets.select("id", "n", "bits", F.posexplode("head").alias("at", "word"))
    one = heads.select("word", *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "at", "bits")))
    two = heads.select("word", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "at", "bits")))
    needed = _needed(similarity)
    longer = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    return (
        one.join(two, "word")
        .filter(
            longer
            & (F.col("n_a") >= similarity * F.col("n_b") - 1e-9)
            # as if it were the first word that they share; of a pair that matches, the first one passes
            & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= needed)
            & (_differ("bits") <= F.col("n_a") + F.col("n_b") - 2 * needed)
        )
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        .distinct()
    )


def similar_sets(candidates: DataFrame, met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ``candidates`` with at least that Jaccard similarity.

    ``met`` (id, n, words, 256 parity bits) has the sets of all candidates; the
    bits are compared before words move.
    """
    bits = [c for c in met.columns if c.startswith("bits")]
    for end in "ab":
        marks = met.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", *bits)))
        candidates = candidates.join(marks, end)
    differ = reduce(Column.__add__, map(_differ, bits))
    candidates = candidates.filter(differ <= F.col("n_a") + F.col("n_b") - 2 * _needed(similarity)).select("a", "b")
    candidates = materialize(candidates, "line-candidates-left")
    common = F.size(F.array_intersect("words_a", "words_b"))
    return (
        candidates.join(met.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a")
        .join(met.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
        .withColumn("common", common)
        .filter(
            F.col("common") >= similarity * (F.size("words_a") + F.size("words_b") - F.col("common")) - 1e-9
        )
        .select("a", "b")
    )


def _met_words(candidates: DataFrame, sets: DataFrame, given: DataFrame) -> DataFrame:
    """(id, n, words, bits) of the candidates, from one text each that has the line: no words are kept for all lines."""
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    places = sets.select("id", "mark", "first.line").join(wanted, "id", "left_semi")
    of_text = places.groupBy("mark").agg(F.collect_list(F.struct("line", "id")).alias("places"))
    texts = given.select(_key(F.col("text")).alias("mark"), "text").dropDuplicates(["mark"])
    # the text is split by a generator, once and not again for each of its places
    split = texts.join(of_text, "mark").select(F.explode(F.array(_lines(_plain(F.col("text"))))).alias("lines"), "places")
    asked = F.transform("places", lambda p: F.struct(p["id"].alias("id"), F.col("lines")[p["line"]].alias("plain")))
    words = split.select(F.explode(asked).alias("asked")).select("asked.id", hashes_of(F.col("asked.plain")).alias("words"))
    return words.select("id", F.size("words").alias("n"), "words", *(_parity("words", i).alias(f"bits{i}") for i in range(4)))


def line_matches(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per line: row, doc_id, line, has_words, removed, n_links.

    ``row`` numbers the rows of this run, ``line`` the lines of a text from 0;
    ``n_links`` counts the different sets of words that match the line's set.
    """
    if not 0 < similarity <= 1 or math.isnan(similarity):
        raise ValueError("similarity must be above 0 and at most 1")
    # numbered before the lines are taken apart: a number for each text
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    order = word_order(given)
    split = given.select(
        "row", "doc_id", _key(F.col("text")).alias("mark"), F.posexplode(_lines(_plain(F.col("text")))).alias("line", "plain")
    ).withColumn("words", by_rarity(hashes_of(F.col("plain")), order))
    lines = materialize(
        split.select(
            "row",
            "doc_id",
            "line",
            "mark",
            F.size("words").alias("n"),
            F.when(F.size("words") > 0, _key(F.col("words"))).alias("key"),
            _parity("words").alias("bits"),
            head_of(similarity).alias("head"),
        ),
        "lines",
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line")
    # Spark drops the later rows of a key before they move, too
    first = F.row_number().over(Window.partitionBy("key").orderBy(place))
    sets = materialize(
        lines.filter("key IS NOT NULL")
        .withColumn("nth", first)
        .filter("nth = 1")
        .select(F.monotonically_increasing_id().alias("id"), "key", place.alias("first"), "mark", "n", "bits", "head"),
        "line-sets",
    )
    candidates = materialize(candidate_sets(sets, similarity), "line-candidates")
    met = materialize(_met_words(candidates, sets, given), "met-sets")
    pairs = materialize(similar_sets(candidates, met, similarity), "line-links")
    both = pairs.union(pairs.select("b", "a"))
    linked_ids = both.select(F.col("a").alias("id")).distinct()
    of_set = materialize(sets.select("id", "key", "first").join(linked_ids, "id", "left_semi"), "linked-lines")
    linked = (
        both.join(of_set.select(F.col("id").alias("b"), "first"), "b")
        .groupBy(F.col("a").alias("id"))
        .agg(F.min("first").alias("other"), F.count("*").alias("n_links"))
        .join(of_set.select("id", "key"), "id")
        .drop("id")
    )
    earliest = materialize(sets.select("key", "first").join(linked, "key", "left"), "earliest-lines")
    joined = lines.select("row", "doc_id", "line", "key").join(earliest, "key", "left")
    earlier = (place > F.col("first")) | F.coalesce(F.col("other") < place, F.lit(False))
    return joined.select(
        "row",
        "doc_id",
        "line",
        F.col("key").isNotNull().alias("has_words"),
        F.coalesce(F.col("key").isNotNull() & earlier, F.lit(False)).alias("removed"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def document_lines(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_links, removed_lines (their places, ascending)."""
    return (
        line_matches(docs, **options)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.count("*").alias("n_lines"),
            F.count(F.when(F.col("removed"), 1)).alias("n_removed"),
            F.sum("n_links").alias("n_links"),
            F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed_lines"),
        )
        .drop("row")
    )


def remove_repeated_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with all columns, their texts without the removed lines.

    The input is written first, so that its rows keep their numbers.
    """
    row = free_name(docs.columns, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-documents")
    # ties of equal ids are told apart by the number, as id and number together are the id here
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    ids = numbered.select(key.alias("doc_id"), F.col(text).alias("text"))
    gone = free_name(docs.columns, "gone")
    lost = (
        line_matches(ids, similarity=similarity)
        .filter("removed")
        .groupBy(F.col("doc_id.row").alias(row))
        .agg(F.collect_list("line").alias(gone))
    )
    left = F.array_join(F.filter(_lines(F.col(text)), lambda _, i: ~F.array_contains(gone, i)), "\n")
    return (
        numbered.join(lost, row, "left")
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left))
        .select(*docs.columns)
    )
