"""One query per operator; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import scores, text
from linkloom.operators import (
    blocking,
    evaluation,
    expansion,
    labels,
    matching,
    neighbors,
    rank_aggregation,
    relations,
    weighting,
)
from linkloom.plans.paths import evaluate_paths, resolve_paths
from linkloom.plans.resolver import ResolverConfig
from linkloom.runtime import fresh_path, materialize
from linkloom.sources import readers, writers
from workloads import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Every entity is bounded, however few pairs it would form.
BOUNDED = 0
TOP_L = 5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources and functions ----------------------------------------------


@query
def parse_blocks(spark, sf):
    return readers.parse_blocks(views.order_block_lines(spark, sf))


@query
def entity_ids(spark, sf):
    return views.star_entities(spark, sf, 1).unionByName(views.star_entities(spark, sf, 2))


@query
def parse_triples(spark, sf):
    both = views.triple_lines(spark, sf, 1).unionByName(views.triple_lines(spark, sf, 2))
    lines = views.written(both, "triple-lines")
    relation_view = readers.parse_relations(lines).withColumn("view", F.lit("relations"))
    label_view = readers.parse_statements(lines).withColumn("view", F.lit("labels"))
    return relation_view.unionByName(label_view)


@query
def ground_truth(spark, sf):
    return views.star_truth(spark, sf)


@query
def ground_truth_ids(spark, sf):
    """Customers of collection 1 with their orders of collection 2: the ids of a line differ."""
    customer = F.col("o_custkey").cast("bigint") * len(views.KINDS) + views.KINDS["customer"]
    pairs = views.table(spark, sf, "orders").select(
        F.concat_ws("\t", customer.cast("string"), views.file_id("order").cast("string")).alias("value")
    )
    return readers.parse_ground_truth_ids(views.written(pairs, "truth-ids"))


@query
def assign_entity_ids(spark, sf):
    """Customers numbered in the order in which they first place an order."""
    orders = views.table(spark, sf, "orders").select(
        F.concat(F.lit("<http://kb1/customer/"), F.col("o_custkey").cast("string"), F.lit(">")).alias("s"),
        F.col("o_orderkey").alias("position"),
    )
    return readers.assign_entity_ids(orders, range_size=4096)


@query
def assign_entity_ids_files(spark, sf):
    """Subjects of several triple files numbered in the order of the files."""
    placed = readers.read_placed_lines(spark, views.order_statement_files(spark, sf, 1))
    return readers.number_subjects(placed)


@query
def ground_truth_from_triples(spark, sf):
    """The truth by places in the triple files, without a file of ids."""
    subjects = [
        readers.number_subjects(
            readers.read_placed_lines(spark, views.order_statement_files(spark, sf, c)), as_written=True
        )
        for c in (1, 2)
    ]
    lines = views.written(views.customer_pair_lines(spark, sf), "truth-lines")
    return readers.parse_ground_truth_by_subjects(lines, *subjects)


@query
def ground_truth_roundtrip(spark, sf):
    """The truth with ids, written and read again."""
    path = fresh_path(spark, "truth-ids")
    writers.write_matches(views.star_truth(spark, sf), path)
    return readers.parse_matches(readers.read_lines(spark, path))


@query
def block_roundtrip(spark, sf):
    """Blocks written with at most 50 entities on a line, and read again."""
    path = fresh_path(spark, "blocks")
    writers.block_lines(views.supplier_members(spark, sf), 50).write.text(path)
    return readers.parse_blocks(readers.read_lines(spark, path))


@query
def uri_encode(spark, sf):
    pages = views.table(spark, sf, "pages")
    name = F.replace("url", F.lit("/"), F.lit("("))
    resource = F.concat(F.lit(text.URI_PREFIX), name, F.lit(">"))
    other = F.concat(F.lit("<"), F.col("url"), F.lit(">"))
    return pages.select(
        "page_id", text.uri_encode(resource).alias("resource"), text.uri_encode(other).alias("other")
    )


@query
def normalize_label(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.normalize_label(F.col("text")).alias("label"))


@query
def match_roundtrip(spark, sf):
    path = fresh_path(spark, "matches")
    writers.write_matches(views.document_truth(spark, sf), path)
    return readers.parse_matches(readers.read_lines(spark, path))


@query
def candidate_roundtrip(spark, sf):
    path = fresh_path(spark, "candidates")
    writers.write_candidates(views.star_resolver(spark, sf).value_candidates(), path)
    return writers.read_candidates(spark, path)


@query
def candidate_text(spark, sf):
    kept = views.star_resolver(spark, sf).kept_value_candidates("cbs")
    return writers.candidate_lines(kept.withColumn("score", F.col("score").cast("bigint")))


# ---- blocking -----------------------------------------------------------


@query
def token_blocking(spark, sf):
    return blocking.token_blocking(views.documents(spark, sf))


@query
def block_utility(spark, sf):
    return blocking.block_utility(materialize(views.document_members(spark, sf), "members"))


@query
def block_filtering(spark, sf):
    return views.document_resolver(spark, sf).entity_index


@query
def rebuild_blocks(spark, sf):
    return views.document_resolver(spark, sf).sized_blocks


@query
def blocking_stats(spark, sf):
    stats = views.document_resolver(spark, sf).stats()
    return stats.withColumn("comparisons", F.col("comparisons").cast("bigint"))


@query
def blocks_per_entity(spark, sf):
    return blocking.blocks_per_entity(views.document_resolver(spark, sf).entity_index)


@query
def block_weights(spark, sf):
    r = views.document_resolver(spark, sf)
    totals = blocking.side_counts(r.entity_index)
    weights = blocking.block_weights(
        r.sized_blocks, totals.select("n1_total").scalar(), totals.select("n2_total").scalar()
    )
    rounded = [scores.from_fixed(scores.to_fixed(F.col(c))).alias(c) for c in ("arcs", "idf1", "idf2")]
    return weights.select("block_id", "n1", "n2", *rounded)


@query
def candidate_pairs(spark, sf):
    """The expansion of every block: each entity with each of its candidates."""
    return expansion.all_block_pairs(views.document_resolver(spark, sf).sized_blocks)


def _chosen(entity_id):
    """The entities that are looked up against all rows."""
    return entity_id % 100 == 0


@query
def expanded_block_pairs(spark, sf):
    return expansion.block_pairs(views.document_resolver(spark, sf).sized_blocks, _chosen)


# ---- weighting ----------------------------------------------------------


@query
def wjs_entity_weights(spark, sf):
    r = views.document_resolver(spark, sf)
    return weighting.entity_weights(r.sized_blocks, r.entity_index).select(
        "entity_id", scores.from_fixed(F.col("norm")).alias("weight")
    )


@query
def cnp_cbs(spark, sf):
    return views.document_resolver(spark, sf).value_candidates("cbs")


@query
def cnp_wjs(spark, sf):
    return views.document_resolver(spark, sf).value_candidates("wjs")


@query
def cnp_idf(spark, sf):
    return views.document_resolver(spark, sf).value_candidates("idf")


@query
def cnp_arcs(spark, sf):
    return views.document_resolver(spark, sf).value_candidates("arcs")


@query
def cnp_arcs_top1(spark, sf):
    return views.document_resolver(spark, sf, k=1).value_candidates("arcs")


@query
def cnp_arcs_heavy(spark, sf):
    """As `cnp_arcs`, with score bounds for every entity."""
    return views.document_resolver(spark, sf, effort=BOUNDED).value_candidates("arcs")


@query
def cnp_wjs_heavy(spark, sf):
    return views.star_resolver(spark, sf, effort=BOUNDED).value_candidates("wjs")


# ---- relations and neighbours -------------------------------------------


def _resolved(spark, sf, collection, view="relations"):
    triples = views.star_statements(spark, sf, collection)
    if view == "relations":
        triples = readers.relation_view(triples)
    entities = materialize(views.star_entities(spark, sf, collection), "entities")
    return materialize(relations.resolve_triples(triples, entities), "resolved")


def _relation_index(spark, sf, collection):
    return relations.relation_index(_resolved(spark, sf, collection))


@query
def relation_index(spark, sf):
    return _relation_index(spark, sf, 1).unionByName(_relation_index(spark, sf, 2))


def _of_both(report: Callable[[int], DataFrame]) -> DataFrame:
    """The report of either collection, told apart by ``collection``."""
    first, second = (report(c).withColumn("collection", F.lit(c)) for c in (1, 2))
    return first.unionByName(second)


@query
def relation_support(spark, sf):
    return _of_both(lambda c: relations.relation_stats(_relation_index(spark, sf, c)).select("p", "support"))


@query
def relation_discriminability(spark, sf):
    return _of_both(lambda c: relations.relation_stats(_relation_index(spark, sf, c)).select("p", "discriminability"))


@query
def relation_rank(spark, sf):
    return _of_both(lambda c: relations.relation_rank(relations.relation_stats(_relation_index(spark, sf, c))))


@query
def top_out_neighbors(spark, sf):
    def top(collection: int) -> DataFrame:
        resolved = _resolved(spark, sf, collection)
        return relations.top_out_neighbors(
            resolved.where("o_id is not null"), relations.predicate_stats(resolved), 2
        )

    return _of_both(top)


@query
def in_neighbors(spark, sf):
    return views.star_resolver(spark, sf).in_neighbors


@query
def label_attributes(spark, sf):
    return _of_both(lambda c: relations.label_attributes(_resolved(spark, sf, c, view="labels")))


@query
def neighbor_pairs(spark, sf):
    """The expansion in factored form: candidate edges and their in-degrees."""
    r = views.star_resolver(spark, sf)
    links = neighbors.neighbor_links(r.kept_value_candidates(), r.in_neighbors)
    return links.select("d2_id", "d1_id", scores.from_fixed(F.col("weight")).alias("sim"), "n1", "n2")


@query
def expanded_neighbor_pairs(spark, sf):
    r = views.star_resolver(spark, sf)
    links = materialize(neighbors.neighbor_links(r.kept_value_candidates(), r.in_neighbors), "neighbor-links")

    def chosen(entity_id):
        return views.row_key(entity_id) % 100 == 0

    return expansion.neighbor_pairs(links, r.in_neighbors, chosen)


@query
def neighbor_sum(spark, sf):
    return views.star_resolver(spark, sf).neighbor_candidates(combine="sum")


@query
def neighbor_max(spark, sf):
    return views.star_resolver(spark, sf).neighbor_candidates(combine="max")


@query
def neighbor_sum_heavy(spark, sf):
    """As `neighbor_sum`, with score bounds for every entity."""
    return views.star_resolver(spark, sf, effort=BOUNDED).neighbor_candidates(combine="sum")


# ---- matching -----------------------------------------------------------


def _lists(spark, sf, scheme="arcs", combine="sum", **config):
    r = views.star_resolver(spark, sf, **config)
    return r.kept_value_candidates(scheme), materialize(r.neighbor_candidates(scheme, combine), "neighbors")


def _edges(spark, sf):
    values, nearby = _lists(spark, sf)
    sure = matching.top1_value_matches(values)
    return matching.candidate_edges(matching.rank_scores(values, nearby, sure)), sure


def _scored(df):
    return df.withColumn("score", scores.from_fixed(F.col("weight"))).drop("weight")


@query
def label_blocks(spark, sf):
    parts = [
        labels.label_blocks(
            views.star_statements(spark, sf, c), views.star_entities(spark, sf, c), views.NAME_ATTRIBUTES[c]
        )
        for c in (1, 2)
    ]
    return parts[0].unionByName(parts[1])


@query
def label_matches(spark, sf):
    return views.star_resolver(spark, sf).label_matches()


@query
def top1_value_matches(spark, sf):
    return matching.top1_value_matches(views.star_resolver(spark, sf).kept_value_candidates())


@query
def rank_scores(spark, sf):
    values, nearby = _lists(spark, sf)
    return _scored(matching.rank_scores(values, nearby, matching.top1_value_matches(values)))


@query
def candidate_edges(spark, sf):
    return _scored(_edges(spark, sf)[0])


@query
def reciprocal_edges(spark, sf):
    return _scored(matching.reciprocal_edges(_edges(spark, sf)[0]))


@query
def best_candidate(spark, sf):
    edges, sure = _edges(spark, sf)
    return _scored(matching.best_candidate(matching.joined_edges(edges), sure))


@query
def reciprocal_matches(spark, sf):
    return views.star_resolver(spark, sf).match_without_labels()


@query
def mutual_top1(spark, sf):
    values = views.star_resolver(spark, sf).kept_value_candidates()
    return matching.mutual_top1(values.where("rank = 1"))


@query
def borda_top1(spark, sf):
    return rank_aggregation.borda_top1(*_lists(spark, sf))


@query
def borda_topk(spark, sf):
    return rank_aggregation.borda_topk(*_lists(spark, sf), TOP_L)


@query
def borda_provenance(spark, sf):
    return rank_aggregation.borda_provenance(*_lists(spark, sf), TOP_L)


@query
def borda_counts(spark, sf):
    aggregated = materialize(rank_aggregation.borda_provenance(*_lists(spark, sf), TOP_L), "borda")
    common = rank_aggregation.lists_with_common(aggregated).selectExpr(
        "stack(2, 'lists', lists, 'lists with a common candidate', with_common) as (source, results)"
    )
    return rank_aggregation.provenance_counts(aggregated).unionByName(common)


# ---- workflows ----------------------------------------------------------


@query
def full_workflow(spark, sf):
    return views.star_resolver(spark, sf).run()


def _resolved_files(spark, sf):
    inputs, truth = views.star_files(spark, sf)
    output, work = fresh_path(spark, "resolved"), fresh_path(spark, "work")
    config = ResolverConfig(label_attributes1=views.NAME_ATTRIBUTES[1], label_attributes2=views.NAME_ATTRIBUTES[2])
    return resolve_paths(spark, inputs, output, work, config), output, inputs, truth


@query
def resolve_files(spark, sf):
    """The full workflow from files to a file."""
    return _resolved_files(spark, sf)[0]


@query
def workflow_arcs_reciprocal(spark, sf):
    return views.star_resolver(spark, sf, n_relations=5).match_without_labels()


@query
def workflow_arcs_borda(spark, sf):
    return views.star_resolver(spark, sf, n_relations=5).match_by_borda("arcs", "sum")


@query
def workflow_wjs_borda(spark, sf):
    return views.star_resolver(spark, sf).match_by_borda("wjs", "max")


# ---- evaluation ---------------------------------------------------------


@query
def eval_matches(spark, sf):
    top1 = views.document_resolver(spark, sf, k=1).value_candidates()
    return evaluation.evaluate_matches(evaluation.second_lists(top1), views.document_truth(spark, sf))


@query
def eval_matches_gt(spark, sf):
    top1 = views.document_resolver(spark, sf, k=1).value_candidates()
    return evaluation.evaluate_matches(
        evaluation.second_lists(top1), views.document_truth(spark, sf), truth_only=True
    )


def _eval_values(spark, sf, scheme):
    candidates = views.document_resolver(spark, sf).value_candidates(scheme)
    return evaluation.evaluate_candidates(
        evaluation.symmetric_candidates(candidates), views.document_truth(spark, sf)
    )


@query
def eval_candidates(spark, sf):
    return _eval_values(spark, sf, "arcs")


@query
def eval_candidates_cbs(spark, sf):
    return _eval_values(spark, sf, "cbs")


@query
def eval_candidates_idf(spark, sf):
    return _eval_values(spark, sf, "idf")


@query
def eval_candidates_neighbors(spark, sf):
    nearby = views.star_resolver(spark, sf).neighbor_candidates()
    return evaluation.evaluate_candidates(evaluation.symmetric_candidates(nearby), views.star_truth(spark, sf))


@query
def eval_candidates_neighbors_idf(spark, sf):
    nearby = views.star_resolver(spark, sf).neighbor_candidates("idf")
    return evaluation.evaluate_candidates(evaluation.symmetric_candidates(nearby), views.star_truth(spark, sf))


@query
def eval_missed(spark, sf):
    nearby = views.star_resolver(spark, sf).neighbor_candidates()
    return evaluation.missed_matches(evaluation.symmetric_candidates(nearby), views.star_truth(spark, sf))


@query
def symmetric_candidates(spark, sf):
    return evaluation.symmetric_candidates(views.document_resolver(spark, sf).value_candidates())


@query
def true_positive_ids(spark, sf):
    candidates = views.document_resolver(spark, sf).value_candidates()
    return evaluation.true_positive_ids(
        evaluation.symmetric_candidates(candidates), views.document_truth(spark, sf)
    )


@query
def eval_input_blocks(spark, sf):
    """All distinct pairs of the unfiltered blocks."""
    return evaluation.evaluate_blocks(views.document_members(spark, sf), views.document_truth(spark, sf))


@query
def eval_input_blocks_star(spark, sf):
    return evaluation.evaluate_blocks(views.star_members(spark, sf), views.star_truth(spark, sf))


@query
def eval_provenance(spark, sf):
    aggregated = rank_aggregation.borda_provenance(*_lists(spark, sf), TOP_L)
    second = aggregated.where("entity_id < 0").selectExpr("entity_id as d2_id", "cand_id as d1_id", "source")
    return evaluation.true_positives_by_source(second, views.star_truth(spark, sf))


@query
def eval_by_source(spark, sf):
    """The matches found through each source, beside the totals of all lists."""
    aggregated = rank_aggregation.borda_provenance(*_lists(spark, sf), TOP_L)
    second = aggregated.where("entity_id < 0").selectExpr("entity_id as d2_id", "cand_id as d1_id", "source")
    return evaluation.evaluate_by_source(second, views.star_truth(spark, sf))


@query
def eval_top1_sides(spark, sf):
    values, nearby = _lists(spark, sf)
    truth = materialize(views.star_truth(spark, sf), "truth")
    by_value = evaluation.evaluate_sides(values.where("rank = 1"), truth).withColumn("list", F.lit("values"))
    by_neighbor = evaluation.evaluate_sides(nearby.where("rank = 1"), truth).withColumn("list", F.lit("neighbors"))
    return by_value.unionByName(by_neighbor)


@query
def contributions(spark, sf):
    values, nearby = _lists(spark, sf)
    truth = materialize(views.star_truth(spark, sf), "truth")
    return evaluation.contributions(
        evaluation.symmetric_candidates(values), evaluation.symmetric_candidates(nearby), truth
    )


@query
def contributions_wjs(spark, sf):
    values, nearby = _lists(spark, sf, "wjs", "max")
    truth = materialize(views.star_truth(spark, sf), "truth")
    return evaluation.contributions(
        evaluation.symmetric_candidates(values), evaluation.symmetric_candidates(nearby), truth
    )


@query
def eval_labels(spark, sf):
    return evaluation.evaluate_matches(
        views.star_resolver(spark, sf).label_matches(), views.star_truth(spark, sf), truth_only=True
    )


@query
def eval_full(spark, sf):
    r = views.star_resolver(spark, sf)
    return r.evaluate(r.run(), views.star_truth(spark, sf))


@query
def eval_resolved_files(spark, sf):
    """Written matches against a truth file."""
    _, output, inputs, truth = _resolved_files(spark, sf)
    return evaluate_paths(spark, output, truth, inputs)


@query
def eval_full_without_labels(spark, sf):
    r = views.star_resolver(spark, sf)
    return r.evaluate(r.match_without_labels(), views.star_truth(spark, sf))


@query
def eval_borda(spark, sf):
    """Top-1 per side, and the top L as symmetric lists."""
    lists = _lists(spark, sf)
    truth = materialize(views.star_truth(spark, sf), "truth")
    sides = evaluation.evaluate_sides(rank_aggregation.borda_top1(*lists), truth)
    topk = evaluation.symmetric_candidates(rank_aggregation.borda_topk(*lists, TOP_L))
    return sides.unionByName(evaluation.evaluate_candidates(topk, truth).withColumn("side", F.lit(0)))


@query
def eval_borda_wjs(spark, sf):
    lists = _lists(spark, sf, "wjs", "max")
    return evaluation.evaluate_sides(rank_aggregation.borda_top1(*lists), views.star_truth(spark, sf))
