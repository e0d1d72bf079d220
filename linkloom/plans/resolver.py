"""Workflows: blocking, meta-blocking and matching put together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from linkloom.functions import text
from linkloom.operators import (
    blocking,
    evaluation,
    labels,
    matching,
    neighbors,
    rank_aggregation,
    relations,
    weighting,
)
from linkloom.operators.shared_top_k import EFFORT
from linkloom.runtime import materialize
from linkloom.sources import readers


@dataclass(frozen=True)
class ResolverConfig:
    """Parameters of a run; ``k=None`` takes the mean number of blocks per entity."""

    keep_ratio: float = blocking.KEEP_RATIO
    k: int | None = None
    n_relations: int = 3
    value_factor: float = matching.VALUE_FACTOR
    min_support: float = relations.MIN_SUPPORT
    keep_low_support: bool = False
    sure_score: float = matching.SURE_SCORE
    effort: int = EFFORT
    label_attributes1: tuple[str, ...] = ()
    label_attributes2: tuple[str, ...] = ()
    drop_empty_labels: bool = False
    separator: str = " "
    uri_prefix: str = text.URI_PREFIX


@dataclass
class Resolver:
    """Links two collections.

    members -- ``(block_id, entity_id)``
    statements1, statements2 -- ``(s, p, o)``, as `readers.parse_statements` gives them
    entities1, entities2 -- ``(uri, entity_id)`` with signed ids

    Each table that several steps read is written out once, on first use.
    """

    members: DataFrame
    statements1: DataFrame | None = None
    statements2: DataFrame | None = None
    entities1: DataFrame | None = None
    entities2: DataFrame | None = None
    config: ResolverConfig = field(default_factory=ResolverConfig)

    @cached_property
    def entity_index(self) -> DataFrame:
        members = materialize(self.members, "members")
        return materialize(blocking.block_filtering(members, self.config.keep_ratio), "entity-index")

    @cached_property
    def sized_blocks(self) -> DataFrame:
        return materialize(blocking.rebuild_blocks(self.entity_index), "sized-blocks")

    @cached_property
    def k(self) -> int:
        return self.config.k or blocking.default_k(self.entity_index)

    def stats(self) -> DataFrame:
        return blocking.blocking_stats(self.entity_index, self.sized_blocks)

    def value_candidates(self, scheme: str = "arcs") -> DataFrame:
        """Top-K by values; not written out."""
        return weighting.top_candidates(
            self.sized_blocks,
            self.k,
            scheme,
            entity_index=self.entity_index,
            effort=self.config.effort,
        )

    @cached_property
    def _kept_values(self) -> dict[str, DataFrame]:
        return {}

    def kept_value_candidates(self, scheme: str = "arcs") -> DataFrame:
        """Top-K by values, written out once per scheme."""
        if scheme not in self._kept_values:
            self._kept_values[scheme] = materialize(self.value_candidates(scheme), f"values-{scheme}")
        return self._kept_values[scheme]

    @cached_property
    def entities(self) -> tuple[DataFrame, DataFrame]:
        return materialize(self.entities1, "entities"), materialize(self.entities2, "entities")

    @cached_property
    def statements(self) -> tuple[DataFrame, DataFrame]:
        return materialize(self.statements1, "statements"), materialize(self.statements2, "statements")

    def _in_neighbors(self, collection: int) -> DataFrame:
        cfg = self.config
        statements, entities = self.statements[collection - 1], self.entities[collection - 1]
        triples = readers.relation_view(statements, cfg.separator, cfg.uri_prefix)
        resolved = materialize(relations.resolve_triples(triples, entities), "resolved")
        out_neighbors = relations.top_out_neighbors(
            resolved.where("o_id is not null"),
            relations.predicate_stats(resolved),
            cfg.n_relations,
            cfg.min_support,
            cfg.keep_low_support,
        )
        return relations.in_neighbors(out_neighbors)

    @cached_property
    def in_neighbors(self) -> DataFrame:
        both = relations.merge_in_neighbors(self._in_neighbors(1), self._in_neighbors(2))
        return materialize(both, "in-neighbors")

    def neighbor_candidates(self, scheme: str = "arcs", combine: str = "sum") -> DataFrame:
        """Top-K by the value similarity of the neighbours."""
        return neighbors.top_neighbor_candidates(
            self.kept_value_candidates(scheme),
            self.in_neighbors,
            self.k,
            combine,
            effort=self.config.effort,
        )

    def label_matches(self) -> DataFrame:
        cfg = self.config
        (statements1, statements2), (entities1, entities2) = self.statements, self.entities
        return labels.label_matches(
            labels.label_blocks(statements1, entities1, cfg.label_attributes1, cfg.drop_empty_labels),
            labels.label_blocks(statements2, entities2, cfg.label_attributes2, cfg.drop_empty_labels),
        )

    def match_without_labels(self) -> DataFrame:
        """ARCS values, summed neighbour similarity and reciprocal matching."""
        nearby = materialize(self.neighbor_candidates(), "neighbors-sum")
        return matching.reciprocal_matches(
            self.kept_value_candidates(), nearby, self.config.value_factor, self.config.sure_score
        )

    def run(self) -> DataFrame:
        """The full workflow: label matches first, the rest by `match_without_labels`."""
        certain = materialize(self.label_matches(), "label-matches")
        return matching.override(self.match_without_labels(), certain)

    def match_by_borda(self, scheme: str = "arcs", combine: str = "sum") -> DataFrame:
        """Mutual best candidates after Borda aggregation of both lists."""
        top1 = rank_aggregation.borda_top1(
            self.kept_value_candidates(scheme), self.neighbor_candidates(scheme, combine)
        )
        return matching.mutual_top1(top1)

    def evaluate(self, matches: DataFrame, truth: DataFrame) -> DataFrame:
        return evaluation.evaluate_matches(matches, truth, truth_only=True)
