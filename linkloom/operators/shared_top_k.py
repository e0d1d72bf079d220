"""Exact top-K partners by what two entities share, with score-bounded candidates.

Entities of collection 1 and 2 have *posts* ``(entity_id, link, weight, n1, n2)``:
``n1`` entities of collection 1 and ``n2`` of collection 2 have a post under the
link, and the score of a pair is the sum (or maximum) of the weights of the
links that both have.  With blocks a link is a block; with neighbours it is a
pair of neighbours that are alike.

An entity whose links offer few partners forms all its pairs.  The others would
meet very many partners under their common links, most of which cannot enter
the list.  For them the posts are ordered by falling weight:

* *seeds*: partners under the first links, and the smallest ids under the link
  that would be too many; the best of them are scored exactly.  The K-th of
  these scores is a lower bound of what a listed partner needs;
* *head*: a partner that is first met at a post can score no more than that
  post and those after it.  Posts from which this reaches the bound generate
  partners; the rest, the *tail*, generates none.  Where it just equals the
  bound, only ids up to that of the K-th can enter, and the smallest ids of the
  link suffice;
* the tail completes the scores of those partners that can still reach the bound.

The lists are the same as if every pair had been formed.

Two kinds of tables need neither: where every entity has few links, partners are
looked up by the sets of links they hold (`_by_subsets`); where most pairs share
a link, the pairs are summed in tiles and never listed (`tiles`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import ids, scores
from linkloom.operators import tiles
from linkloom.runtime import materialize

#: An entity is bounded if it would form more than EFFORT * k pairs for each of its links (about where it pays).
EFFORT = 128
#: Seeds that are scored exactly, as a multiple of k; four times as many are looked at.
PROBES = 8
#: Partners are looked up by sets of links if no entity has more links than this.
FEW = 4
#: Pairs are summed in tiles if at least one of so many possible pairs shares a link, counted by links.
DENSE = 8
#: Norms under this, in fixed point, tell any two partners of equal weight apart as doubles.
DISTINCT_NORM = 1e15
#: A link is joined in cells of at most about CELL * CELL pairs.
CELL = 1000


def keep_top(df: DataFrame, key: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key, numbered in ``rank``.

    ``k`` is a literal, so Spark prunes each group before the shuffle.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("cand_id").asc()]


def _combine(combine: str, weight: str | Column) -> Column:
    return F.max(weight) if combine == "max" else F.sum(weight)


def _both_directions(pairs: DataFrame) -> DataFrame:
    forward = F.struct(F.col("d2_id").alias("entity_id"), F.col("d1_id").alias("cand_id"))
    backward = F.struct(F.col("d1_id").alias("entity_id"), F.col("d2_id").alias("cand_id"))
    return pairs.select(F.explode(F.array(forward, backward)).alias("e"), "weight").select(
        "e.entity_id", "e.cand_id", "weight"
    )


def _scored(directed: DataFrame, norms: DataFrame | None, weight: str = "weight") -> DataFrame:
    """Add ``score``; with norms it is the weight over the norms of both ends."""
    if norms is None:
        return directed.withColumn("score", scores.from_fixed(F.col(weight)))
    own = norms.select("entity_id", F.col("norm").alias("own_norm"))
    other = norms.select(F.col("entity_id").alias("cand_id"), F.col("norm").alias("cand_norm"))
    joined = directed.join(own, "entity_id").join(other, "cand_id")
    ratio = _ratio(F.col(weight), F.col("own_norm") + F.col("cand_norm"))
    return joined.withColumn("score", ratio).drop("own_norm", "cand_norm")


def _ratio(weight: Column, norm: Column) -> Column:
    return F.coalesce(F.try_divide(weight.cast("double"), norm.cast("double")), F.lit(0.0))


def in_cells(
    first: DataFrame, second: DataFrame, key1: str | list[str], key2: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with the columns ``row`` and ``col`` to join on as well.

    Both have ``n1`` and ``n2``, the rows that a join key has on either side.  A
    key with many is cut into cells; so a hot key spreads over tasks, and each
    row is repeated only once for about CELL rows of the other side.
    """
    g1 = F.ceil(F.col("n1") / CELL).cast("bigint")
    g2 = F.ceil(F.col("n2") / CELL).cast("bigint")
    zero = F.lit(0).cast("bigint")
    keys1, keys2 = ([k] if isinstance(k, str) else k for k in (key1, key2))
    return (
        first.withColumn("row", F.pmod(F.xxhash64(*keys1), g1)).withColumn("col", F.explode(F.sequence(zero, g2 - 1))),
        second.withColumn("col", F.pmod(F.xxhash64(*keys2), g2)).withColumn("row", F.explode(F.sequence(zero, g1 - 1))),
    )


def in_columns(
    few: DataFrame, many: DataFrame, n_many: str, key_many: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with the column ``col`` to join on as well.

    As `in_cells`, where ``few`` has few rows of a join key: these are repeated for
    every CELL of the ``n_many`` rows on the other side, which stay single.
    """
    g = F.ceil(F.col(n_many) / CELL).cast("bigint")
    keys = [key_many] if isinstance(key_many, str) else key_many
    return (
        few.withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), g - 1))),
        many.withColumn("col", F.pmod(F.xxhash64(*keys), g)),
    )


def grid_join(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(d2_id, d1_id, weight)`` of the posts of both collections under the same link."""
    cut_first, cut_second = in_cells(first, second, "entity_id", "entity_id")
    ours = cut_first.select("link", "row", "col", F.col("entity_id").alias("d1_id"), "weight")
    theirs = cut_second.select("link", "row", "col", F.col("entity_id").alias("d2_id"))
    return ours.join(theirs, ["link", "row", "col"]).select("d2_id", "d1_id", "weight")


def _weighed(pairs: DataFrame, combine: str) -> DataFrame:
    # The links of one pair sit in many tasks, so combining before the shuffle
    # would build large hash tables and merge next to nothing.
    return pairs.repartition("d2_id", "d1_id").groupBy("d2_id", "d1_id").agg(_combine(combine, "weight").alias("weight"))


def _sides(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return posts.where(ids.is_first(F.col("entity_id"))), posts.where(ids.is_second(F.col("entity_id")))


class _Bounded:
    """The steps for the entities that would form too many pairs."""

    def __init__(
        self, posts: DataFrame, wide: DataFrame, k: int, combine: str, norms: DataFrame | None, probes: int
    ) -> None:
        self.k, self.combine, self.norms, self.probes = k, combine, norms, probes * k
        self.n_seeds = 4 * self.probes
        side = F.when(ids.is_first(F.col("entity_id")), F.lit(1)).otherwise(F.lit(2))
        self.posts = posts.withColumn("side", side)
        order = Window.partitionBy("entity_id").orderBy(F.col("weight").desc(), F.col("link"))
        onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.ranked = materialize(
            self.posts.join(wide, "entity_id", "left_semi")
            .withColumn("other", F.lit(3) - F.col("side"))
            .withColumn("reach", _combine(combine, "weight").over(onward))
            .withColumn("offered", F.sum("n_other").over(so_far)),
            "ranked-posts",
        )
        self.smallest = self._smallest_ids()

    def _smallest_ids(self) -> DataFrame:
        """The smallest ids under the links that are too many to be seeds: ``(link, side, cand_id)``."""
        crowded = self._crowded().select("link", F.col("other").alias("side")).distinct()
        under = self.posts.join(crowded, ["link", "side"], "left_semi")
        kept = keep_top(under, ["link", "side"], [F.col("entity_id").asc()], self.n_seeds)
        return materialize(kept.select("link", "side", F.col("entity_id").alias("cand_id")), "smallest-ids")

    def _crowded(self) -> DataFrame:
        """The first post of each entity at which the seeds become too many."""
        return self.ranked.where(
            (F.col("offered") > self.n_seeds) & (F.col("offered") - F.col("n_other") <= self.n_seeds)
        )

    def _partners(self, ranked: DataFrame, members: DataFrame) -> DataFrame:
        theirs = members.select("link", F.col("side").alias("other"), "cand_id")
        return ranked.join(theirs, ["link", "other"])

    def _completed(self, pairs: DataFrame, own: DataFrame, theirs: DataFrame) -> DataFrame:
        """The weights of the links in ``own`` and ``theirs`` that both ends of ``pairs`` have."""
        reached = pairs.select("entity_id", "cand_id").join(own.select("entity_id", "link", "weight"), "entity_id")
        held = theirs.select(F.col("entity_id").alias("cand_id"), "link")
        return reached.join(held, ["cand_id", "link"]).select("entity_id", "cand_id", "weight")

    def _best(self, weights: DataFrame, k: int) -> DataFrame:
        pairs = weights.groupBy("entity_id", "cand_id").agg(_combine(self.combine, "weight").alias("weight"))
        return keep_top(_scored(pairs, self.norms), "entity_id", best_first(), k)

    def kth(self) -> DataFrame:
        """``(entity_id, kth_score, kth_id)``: K partners are at least that good."""
        members = self.posts.withColumn("cand_id", F.col("entity_id")).select("link", "side", "cand_id")
        wanted = ("entity_id", "cand_id", "weight")
        seeds = (
            self._partners(self.ranked.where(F.col("offered") <= self.n_seeds), members)
            .select(*wanted)
            .unionByName(self._partners(self._crowded(), self.smallest).select(*wanted))
        )
        probes = self._best(seeds, self.probes)
        exact = self._best(self._completed(probes, self.ranked, self.posts), self.k)
        return exact.where(F.col("rank") == self.k).select(
            "entity_id", F.col("score").alias("kth_score"), F.col("cand_id").alias("kth_id")
        )

    def cut(self) -> DataFrame:
        """``ranked`` with ``head``, and ``settled`` where the smallest ids of the link suffice."""
        edges = self.smallest.groupBy("link", F.col("side").alias("other")).agg(
            F.count(F.lit(1)).alias("n_small"), F.max("cand_id").alias("edge")
        )
        known = self.ranked.join(self.kth(), "entity_id", "left").join(edges, ["link", "other"], "left")
        if self.norms is None:
            bound = scores.from_fixed(F.col("reach"))
        else:
            known = known.join(self.norms.select("entity_id", "norm"), "entity_id")
            bound = F.try_divide(F.col("reach").cast("double"), F.col("norm").cast("double"))
        few = (F.col("n_other") <= F.col("n_small")) | (F.col("kth_id") <= F.col("edge"))
        settled = F.coalesce((bound == F.col("kth_score")) & few, F.lit(False))
        reaches = F.coalesce(bound >= F.col("kth_score"), F.lit(True))
        return materialize(
            known.select("entity_id", "link", "other", "weight", "kth_score", "kth_id", (reaches & ~settled).alias("head"), settled.alias("settled")),
            "cut-posts",
        )

    def weights(self) -> DataFrame:
        """``(entity_id, cand_id, weight)`` of all pairs that can enter a list, complete."""
        cut = self.cut()
        posts = self.posts.join(cut.select("entity_id", "link", "head"), ["entity_id", "link"], "left")
        posts = materialize(posts.withColumn("head", F.coalesce("head", F.lit(True))), "posts")
        first, second = _sides(posts)
        formed = grid_join(first.where("head"), second).unionByName(grid_join(first.where("NOT head"), second.where("head")))
        ties = (
            self._partners(cut.where("settled"), self.smallest)
            .where(F.col("cand_id") <= F.col("kth_id"))
            .select("entity_id", "cand_id", F.lit(0).cast(dict(posts.dtypes)["weight"]).alias("weight"))
        )
        met = (
            _both_directions(_weighed(formed, self.combine))
            .unionByName(ties)
            .groupBy("entity_id", "cand_id")
            .agg(_combine(self.combine, "weight").alias("weight"))
        )
        tails = (
            cut.where("NOT head")
            .groupBy("entity_id")
            .agg(_combine(self.combine, "weight").alias("tail"), F.max("kth_score").alias("kth_score"), F.max("kth_id").alias("kth_id"))
        )
        met = materialize(met.join(tails, "entity_id", "left"), "met-pairs")
        most = F.greatest("weight", "tail") if self.combine == "max" else F.col("weight") + F.col("tail")
        hopeful = _scored(met.where("tail IS NOT NULL").withColumn("most", most), self.norms, "most")
        beaten = (F.col("score") < F.col("kth_score")) | (
            (F.col("score") == F.col("kth_score")) & (F.col("cand_id") > F.col("kth_id"))
        )
        hopeful = materialize(
            hopeful.where(~F.coalesce(beaten, F.lit(False))).select("entity_id", "cand_id", "weight"), "hopeful-pairs"
        )
        tail = self._completed(hopeful, cut.where("NOT head"), posts.where("NOT head"))
        finished = hopeful.unionByName(tail).groupBy("entity_id", "cand_id").agg(_combine(self.combine, "weight").alias("weight"))
        return met.where("tail IS NULL").select("entity_id", "cand_id", "weight").unionByName(finished)


def top_partners(
    posts: DataFrame,
    k: int,
    *,
    combine: str = "sum",
    norms: DataFrame | None = None,
    effort: int = EFFORT,
    probes: int = PROBES,
) -> DataFrame:
    """Top-K partners of every entity: ``(entity_id, cand_id, score, rank)``.

    posts -- ``(entity_id, link, weight, n1, n2)``, at most one for an entity
        and link; weight in fixed point.  Read several times
    norms -- optional ``(entity_id, norm)``; scores become weight / (norm + norm)
    effort, probes -- see EFFORT and PROBES; they change the work, not the result

    One row of counts is read first.  Sums are 64-bit where the heaviest entity
    proves that they fit, else decimals of 38 digits.
    """
    n_other = F.when(ids.is_first(F.col("entity_id")), F.col("n2")).otherwise(F.col("n1"))
    posts = posts.withColumn("n_other", n_other.cast("double"))
    wide = F.col("offered") > F.lit(float(effort * k)) * F.col("links")
    entities = posts.groupBy("entity_id").agg(
        F.sum("n_other").alias("offered"),
        F.count(F.lit(1)).alias("links"),
        F.sum(F.col("weight").cast("double")).alias("mass"),
        F.min(F.col("weight").cast("double")).alias("least"),
        F.max(F.col("weight").cast("double")).alias("most"),
    )
    row = entities.agg(
        F.count_if(wide).alias("wide"),
        F.max("mass").alias("mass"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.max("links").alias("links"),
        F.sum("offered").alias("offered"),
        F.count_if(ids.is_first(F.col("entity_id"))).alias("n1"),
        F.count_if(ids.is_second(F.col("entity_id"))).alias("n2"),
    ).first()
    kind = "bigint" if (row["mass"] or 0.0) < scores.LARGEST_SUM else "decimal(38,0)"
    posts = posts.withColumn("weight", F.col("weight").cast(kind))
    largest_norm = 0.0
    if norms is not None:
        largest_norm = float(norms.agg(F.max("norm")).first()[0] or 0)
    if (row["links"] or 0) <= FEW and (row["least"] or 0.0) >= 0 and largest_norm < DISTINCT_NORM:
        sets = materialize(_link_sets(posts, norms), "link-sets")
        if sets.where(F.size("names") != F.size(F.array_distinct("names"))).isEmpty():
            return _by_subsets(sets, k, combine, norms is not None)
    dense = (row["offered"] or 0.0) * DENSE >= 2.0 * row["n1"] * row["n2"]
    fits = max(row["mass"] or 0.0, 2 * largest_norm) < scores.LARGEST_SUM and (row["most"] or 0.0) < tiles.LARGEST_EXACT
    exact = fits and (row["least"] or 0.0) >= 0
    if combine == "sum" and dense and exact:
        return tiles.top_in_tiles(posts, k, norms, row["n1"], row["n2"])
    if row["wide"]:
        chosen = materialize(entities.where(wide).select("entity_id"), "wide-entities")
        weights = _Bounded(posts, chosen, k, combine, norms, probes).weights()
    else:
        weights = _both_directions(_weighed(grid_join(*_sides(posts)), combine))
    best = keep_top(_scored(weights, norms), "entity_id", best_first(), k)
    return best.select("entity_id", "cand_id", "score", "rank")


def _link_sets(posts: DataFrame, norms: DataFrame | None) -> DataFrame:
    """``(entity_id, first, names, weights, norm)``: the links of every entity in one order."""
    held = F.sort_array(F.collect_list(F.struct("link", "weight")))
    sets = posts.where("entity_id IS NOT NULL AND link IS NOT NULL").groupBy("entity_id").agg(held.alias("held"))
    if norms is not None:
        sets = sets.join(norms.select("entity_id", "norm"), "entity_id")
    return sets.select(
        "entity_id",
        ids.is_first(F.col("entity_id")).alias("first"),
        F.col("held.link").alias("names"),
        F.col("held.weight").alias("weights"),
        (F.lit(0) if norms is None else F.col("norm")).cast("decimal(38,0)").alias("norm"),
    )


def _subsets(values: str, number: Column) -> Column:
    """The entries of an array of at most FEW that the bits of ``number`` name."""
    bits = F.array(*[F.lit(1 << b) for b in range(FEW)])
    return F.filter(values, lambda _, i: number.bitwiseAND(F.element_at(bits, i + 1)) > 0)


def _by_subsets(sets: DataFrame, k: int, combine: str, with_norms: bool) -> DataFrame:
    """`top_partners` of entities with few links, without forming their pairs.

    Let T be what a listed partner shares with an entity.  Whoever holds T and
    comes before that partner, by norm and id, scores no less and comes before
    it in the list as well.  So the partner is among the first K holders of T,
    and the K best over all subsets T of an entity's links are its list.
    Entities with the same links (and norm) have the same list; it is found once.
    """
    alike = ["first", "names", "weights", "norm"]
    classes = materialize(sets.groupBy(*alike).agg(F.min("entity_id").alias("class_id")), "link-classes")
    number = F.explode(F.expr("sequence(1, shiftleft(1, size(names)) - 1)")).alias("number")

    def with_subsets(rows: DataFrame, *columns: str) -> DataFrame:
        found = rows.select("*", number).select(
            *columns, "norm", _subsets("names", F.col("number")).alias("held"), _subsets("weights", F.col("number")).alias("parts")
        )
        zero = F.lit(0).cast(sets.schema["weights"].dataType.elementType)
        if combine == "max":
            total = F.array_max("parts")
        else:
            total = F.aggregate("parts", zero, lambda a, b: (a + b).cast(sets.schema["weights"].dataType.elementType))
        return found.withColumn("weight", total).drop("parts")

    # with a weight of 0 the norm decides nothing
    order = [F.when(F.col("weight") > 0, F.col("norm")).otherwise(F.lit(0)), F.col("entity_id")]
    some = keep_top(sets, alike, [F.col("entity_id").asc()], k).drop("rank")
    holders = keep_top(with_subsets(some, "entity_id", "first"), ["first", "held"], order, k)
    theirs = holders.select(
        (~F.col("first")).alias("first"), "held", F.col("entity_id").alias("cand_id"), F.col("norm").alias("cand_norm")
    )
    met = with_subsets(classes, "class_id", "first").join(theirs, ["first", "held"])
    # found through several subsets: the largest is what both share
    pairs = met.groupBy("class_id", "cand_id").agg(
        F.max("weight").alias("weight"), F.first("norm").alias("norm"), F.first("cand_norm").alias("cand_norm")
    )
    if with_norms:
        score = _ratio(F.col("weight"), F.col("norm") + F.col("cand_norm"))
    else:
        score = scores.from_fixed(F.col("weight"))
    lists = keep_top(pairs.withColumn("score", score), "class_id", best_first(), k)
    members = sets.join(classes, alike).select("class_id", "entity_id")
    return members.join(lists.select("class_id", "cand_id", "score", "rank"), "class_id").select(
        "entity_id", "cand_id", "score", "rank"
    )


def link_posts(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """Posts of entities that have features, under the links between features.

    left, right -- ``(entity_id, feature)`` of collection 1 and 2
    links -- ``(f1, f2, weight, n1, n2)``: weight in fixed point and how many
        entities carry ``f1`` and ``f2``
    """
    named = links.select("f1", "f2", F.struct("f1", "f2").alias("link"), "weight", "n1", "n2")
    first = left.withColumnRenamed("feature", "f1").join(named, "f1")
    second = right.withColumnRenamed("feature", "f2").join(named, "f2")
    columns = ("entity_id", "link", "weight", "n1", "n2")
    return first.select(*columns).unionByName(second.select(*columns))
