"""CausalGraph: nodes, edges and modules as DataFrames, checked and weighed when built."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import confidence
from .plans.lineage import checkpoint

CATEGORIES = ("STOCK", "STATE", "BOUNDARY", "PROCESS")
RELATIONS = (
    "amplifies association binds catalyzes causesNoChange decreases degrades directlyDecreases directlyIncreases disrupts "
    "increases inhibits modulates produces protects regulates requires substrateof transports traps"
).split()


class GraphError(ValueError):
    pass


class CausalGraph:
    """A directed multigraph; parallel edges stay apart, `ord` is the order of input.

    nodes: id, label, category, subtype, module_id, roles, ..., ord
    edges: id, source, target, relation, causal_confidence, pmid, method_type, ..., ord
    Instances don't change; updates make new ones.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, modules: DataFrame | None = None, weights: dict | None = None, scheme: confidence.Scheme | None = None, check: bool = False, checked_edges: DataFrame | None = None):
        self.nodes, self.modules, self.weights, self.scheme = nodes, modules, weights, scheme
        self.edges = confidence.weigh(edges, weights, scheme) if checked_edges is None else checked_edges
        if check:
            self.validate()

    def validate(self) -> None:
        """Raise where an endpoint is missing or a category or relation unknown."""
        bad = self.dangling().select("id").head(3)
        if bad:
            raise GraphError(f"edges without a node at an end: {[r.id for r in bad]}")
        for df, col, domain in ((self.nodes, "category", CATEGORIES), (self.edges, "relation", RELATIONS)):
            wrong = df.where(F.col(col).isNull() | ~F.col(col).isin(*domain)).select("id", col).head(3)
            if wrong:
                raise GraphError(f"unknown {col}: {[tuple(r) for r in wrong]}")

    def dangling(self) -> DataFrame:
        ids = self.nodes.select(F.col("id").alias("__id"))
        one = self.edges.join(ids, F.col("source") == F.col("__id"), "left_anti")
        return one.unionByName(self.edges.join(ids, F.col("target") == F.col("__id"), "left_anti")).dropDuplicates(["id"])

    @cached_property
    def edges_rep(self) -> DataFrame:
        """One edge for each (source, target): the last by ord."""
        cols = self.edges.columns
        best = self.edges.groupBy("source", "target").agg(F.max_by(F.struct(*cols), "ord").alias("e"))
        return best.select(*[F.col(f"e.{c}").alias(c) for c in cols])

    def pairs(self) -> DataFrame:
        return self.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))

    def stored(self) -> CausalGraph:
        """The same graph with its tables written out once, for many passes."""
        return CausalGraph(checkpoint(self.nodes), self.edges, self.modules, self.weights, self.scheme, checked_edges=checkpoint(self.edges))

    def update(self, nodes: DataFrame, edges: DataFrame, modules: DataFrame | None = None) -> CausalGraph:
        return CausalGraph(nodes, edges, modules, self.weights, self.scheme)

    def subgraph(self, ids: DataFrame) -> CausalGraph:
        """Induced by ids(id): unknown ids drop out, levels and weights stay, modules go."""
        keep = ids.select(F.col("id").alias("__id")).distinct()
        nodes = self.nodes.join(keep, F.col("id") == F.col("__id"), "left_semi")
        inner = self.edges.join(keep, F.col("source") == F.col("__id"), "left_semi").join(keep, F.col("target") == F.col("__id"), "left_semi")
        return CausalGraph(nodes, inner, None, self.weights, None, checked_edges=inner)
