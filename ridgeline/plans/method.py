"""One interface for search methods, so that they can be compared on the same data, and the region index behind it."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from ..functions.predicates import DNF
from ..operators import graph, knn, navigate, search, stats


@dataclass(frozen=True)
class BuildParams:
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    buckets: int = stats.BUCKETS
    lmin: int = 1
    lmax: int = -1
    slack: float = 1.0
    delta_range: float = 0.05
    eps_point: float = 0.10
    budget: int = 0


class Method(Protocol):
    def build(self, base: DataFrame, params: BuildParams) -> None: ...

    def search(self, queries: DataFrame, predicate: DNF, k: int) -> DataFrame: ...

    def persistent_bytes(self) -> int: ...


class ExactScan:
    """No index: the answer that all others are measured against."""

    def build(self, base: DataFrame, params: BuildParams) -> None:
        self.base = base

    def search(self, queries: DataFrame, predicate: DNF, k: int) -> DataFrame:
        return knn.exact_topk(self.base, queries, k, predicate=predicate)

    def persistent_bytes(self) -> int:
        return 0


class PostFilter(ExactScan):
    """The ef nearest first, the predicate after: approximate, the more so the rarer matches are."""

    def __init__(self, ef: int):
        self.ef = ef

    def search(self, queries: DataFrame, predicate: DNF, k: int) -> DataFrame:
        return knn.post_filter(self.base, queries, predicate, self.ef, k)


class GraphSearch(ExactScan):
    """A walk along a navigable graph, which passes rows that don't match as policy says."""

    def __init__(self, ef: int, policy: str = navigate.ADAPTIVE):
        self.ef, self.policy = ef, policy

    def build(self, base: DataFrame, params: BuildParams) -> None:
        self.base, self.graph = base, navigate.build(base)

    def search(self, queries: DataFrame, predicate: DNF, k: int) -> DataFrame:
        return navigate.beam_search(self.graph, queries, k, ef=self.ef, base=self.base, predicate=predicate, policy=self.policy)

    def persistent_bytes(self) -> int:
        return navigate.graph_bytes(self.graph)


@dataclass
class RegionIndex:
    """Regions with histograms and presence: exact answers from the regions that presence admits."""

    added: dict[str, float] = field(default_factory=dict)

    def build(self, base: DataFrame, params: BuildParams) -> None:
        self.params, self.base = params, base
        self.nodes = graph.nodes(base)
        self.forest = stats.forest(self.nodes, params.lmin, params.lmax)
        self._statistics()

    def _statistics(self) -> None:
        p = self.params
        schema = stats.schema_of(self.base, p.numeric, p.categorical, p.buckets)
        self.stats = stats.forest_stats(self.forest, self.base, schema, slack=p.slack, delta_range=p.delta_range, eps_point=p.eps_point, budget=p.budget)

    def add_column(self, base: DataFrame, name: str, *, categorical: bool) -> float:
        """Takes base with a new column into the statistics; regions' graph stays. Gives the seconds that it took."""
        began = time.perf_counter()
        kept = {**self.params.__dict__, "numeric": (*self.params.numeric, *(() if categorical else (name,))), "categorical": (*self.params.categorical, *((name,) if categorical else ()))}
        self.params, self.base = BuildParams(**kept), base
        self._statistics()
        self.added[name] = time.perf_counter() - began
        return self.added[name]

    def search(self, queries: DataFrame, predicate: DNF, k: int) -> DataFrame:
        return search.search(self.base, self.stats, queries, predicate, k)

    def persistent_bytes(self) -> int:
        return int(sum(r["bytes"] for r in stats.storage_bytes(self.stats).collect()))


@dataclass
class RoutedIndex(RegionIndex):
    """Regions searched as the cost model routes each: scanned whole, or along a navigable graph."""

    ef: int = 64
    force: str | None = None

    def build(self, base: DataFrame, params: BuildParams) -> None:
        super().build(base, params)
        self.graph = navigate.build(base)

    def _statistics(self) -> None:
        super()._statistics()
        self.stored = search.by_region(self.base, self.stats)

    def search(self, queries: DataFrame, predicate: DNF, k: int) -> DataFrame:
        strategy = search.routing_table(self.stats, predicate, k, force=self.force)
        return navigate.routed_search(self.graph, self.stored, self.stats, strategy, queries, predicate, k, ef=self.ef)

    def persistent_bytes(self) -> int:
        return super().persistent_bytes() + navigate.graph_bytes(self.graph)
