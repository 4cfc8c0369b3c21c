"""Projection, lookup, filtering and subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.confidence import CUTOFFS
from ..graph import CausalGraph
from ..plans.iterate import components


def stats(g: CausalGraph) -> DataFrame:
    return g.nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edge_count")))


def node(g: CausalGraph, node_id: str) -> DataFrame:
    return g.nodes.where(F.col("id") == node_id)


def successors(g: CausalGraph, node_id: str) -> DataFrame:
    """One row for each edge out, the latest first."""
    return g.edges.where(F.col("source") == node_id).orderBy(F.col("ord").desc()).select(F.col("target").alias("id"), F.col("id").alias("edge_id"))


def predecessors(g: CausalGraph, node_id: str) -> DataFrame:
    return g.edges.where(F.col("target") == node_id).orderBy(F.col("ord").desc()).select(F.col("source").alias("id"), F.col("id").alias("edge_id"))


def edge_between(g: CausalGraph, source: str, target: str) -> DataFrame:
    return g.edges_rep.where((F.col("source") == source) & (F.col("target") == target))


def edges_by(g: CausalGraph, source: str | None = None, target: str | None = None, module: str | None = None) -> DataFrame:
    out = g.edges
    for col, value in (("source", source), ("target", target), ("module_id", module)):
        if value is not None:
            out = out.where(F.col(col) == value)
    return out


def neighbours(g: CausalGraph, node_id: str, upstream: bool) -> DataFrame:
    """Node records one edge away; ends without a record drop out."""
    here, there = ("target", "source") if upstream else ("source", "target")
    ends = g.edges.where(F.col(here) == node_id).select(F.col(there).alias("__n"))
    return ends.join(g.nodes, F.col("__n") == F.col("id")).drop("__n")


def adjacency(g: CausalGraph) -> DataFrame:
    """(id, targets) with isolated nodes; targets sorted, one entry an edge."""
    out = g.edges.groupBy(F.col("source").alias("__s")).agg(F.array_sort(F.collect_list("target")).alias("t"))
    return g.nodes.select("id").join(out, F.col("id") == F.col("__s"), "left").select("id", F.coalesce("t", F.array().cast("array<string>")).alias("targets"))


def inspector(g: CausalGraph) -> DataFrame:
    """For each node the number of edges in and out, its module's name and the modules it touches."""
    ins = g.edges.groupBy(F.col("target").alias("i")).agg(F.count(F.lit(1)).alias("n_in"))
    outs = g.edges.groupBy(F.col("source").alias("o")).agg(F.count(F.lit(1)).alias("n_out"))
    names = g.modules.select(F.col("id").alias("m"), F.col("name").alias("module_name"))
    rows = g.nodes.join(ins, F.col("id") == F.col("i"), "left").join(outs, F.col("id") == F.col("o"), "left").join(names, F.col("module_id") == F.col("m"), "left")
    return rows.select("id", "label", "module_name", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def module_counts(g: CausalGraph, boundary: str = "BOUNDARY") -> DataFrame:
    """Nodes by module, the boundary module first."""
    rows = g.nodes.groupBy("module_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return rows.orderBy((F.col("module_id") != boundary), "module_id")


def module_categories(g: CausalGraph, mapping: dict[str, str], order: list[str], missing: str = "boundary") -> DataFrame:
    """(category, modules) in a fixed order of categories."""
    from ..functions.scalars import literal_map

    cat = F.coalesce(literal_map(mapping)[F.col("module_id")], F.lit(missing))
    rows = g.nodes.select("module_id").distinct().groupBy(cat.alias("category")).agg(F.array_sort(F.collect_set("module_id")).alias("modules"))
    return rows.orderBy(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category")))


# ---- filters


def filter_by_modules(g: CausalGraph, modules: list[str]) -> DataFrame:
    return g.nodes.where(F.col("module_id").isin(*modules)).select("id")


def filter_edges_by_confidence(g: CausalGraph, level: str) -> DataFrame:
    return g.edges.where(F.col("conf_rank") <= int(level[1])).select("id")


def modules_for_nodes(g: CausalGraph, ids: DataFrame) -> DataFrame:
    return g.nodes.join(ids.select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_semi").select("module_id").distinct()


def passes_cutoff(level: Column, cutoff: str) -> Column:
    """Whether a level passes strong, moderate or all; a missing one passes all only."""
    if cutoff == "all":
        return F.lit(True)
    return F.coalesce(F.substring(level, 2, 1).cast("int") <= CUTOFFS[cutoff], F.lit(False))


def view_filter(g: CausalGraph, modules: list[str], cutoff: str = "all", drop_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of the modules that are on, edges between them that pass the cutoff, on request no orphans."""
    nodes = g.nodes.where(F.col("module_id").isin(*modules))
    ids = nodes.select(F.col("id").alias("__i"))
    edges = g.edges.where(passes_cutoff(F.col("causal_confidence"), cutoff))
    edges = edges.join(ids, F.col("source") == F.col("__i"), "left_semi").join(ids, F.col("target") == F.col("__i"), "left_semi")
    return (strip_orphans(nodes, edges) if drop_orphans else nodes), edges


def strip_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("__e")).union(edges.select("target"))
    return nodes.join(ends, F.col("id") == F.col("__e"), "left_semi")


def high_confidence(g: CausalGraph) -> DataFrame:
    return g.edges.where("conf_rank <= 3")


def cross_module(g: CausalGraph) -> DataFrame:
    m = g.nodes.select(F.col("id").alias("n"), F.col("module_id").alias("m"))
    rows = g.edges.join(m.withColumnsRenamed({"n": "n1", "m": "source_module"}), F.col("source") == F.col("n1")).join(m.withColumnsRenamed({"n": "n2", "m": "target_module"}), F.col("target") == F.col("n2"))
    return rows.where("source_module <> target_module").drop("n1", "n2")


def with_role(g: CausalGraph, role: str) -> DataFrame:
    return g.nodes.where(F.array_contains("roles", role))


def hubs(g: CausalGraph, least: int = 5) -> DataFrame:
    ends = g.edges.select(F.col("source").alias("id")).union(g.edges.select("target"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)


def search(g: CausalGraph, query: str, most: int = 20, description: bool = False) -> DataFrame:
    """Nodes whose label or id (or description) holds the query, in input order; none for under two characters."""
    q = query.lower()
    hit = F.lower("label").contains(q) | F.lower("id").contains(q)
    if description:
        hit = hit | F.coalesce(F.lower("description").contains(q), F.lit(False))
    return g.nodes.where(hit & F.lit(len(q) >= 2)).orderBy("ord").limit(most).select("id", "label")


def focus(g: CausalGraph, node_id: str, legacy: bool = False) -> DataFrame:
    """(module_id, state): the node's module on; its neighbours' modules on, or in the legacy mode its component's partial; the rest off."""
    own = g.nodes.where(F.col("id") == node_id).select(F.col("module_id").alias("m0"))
    if legacy:
        scoped = lambda df: df.withColumn("scope", F.lit(0))
        comp = components(scoped(g.nodes.select(F.col("id").alias("node"))), scoped(g.pairs().toDF("a", "b")))
        mine = comp.where(F.col("node") == node_id).select(F.col("component").alias("c"))
        near, state = comp.join(mine, F.col("component") == F.col("c"), "left_semi").select(F.col("node").alias("__n")), "partial"
    else:
        out = g.edges.where(F.col("source") == node_id).select(F.col("target").alias("__n"))
        near, state = out.union(g.edges.where(F.col("target") == node_id).select("source")), "on"
    mods = g.nodes.join(near, F.col("id") == F.col("__n"), "left_semi").select(F.col("module_id").alias("m1")).distinct()
    rows = g.nodes.select("module_id").distinct().join(own, F.col("module_id") == F.col("m0"), "left").join(mods, F.col("module_id") == F.col("m1"), "left")
    return rows.select("module_id", F.when(F.col("m0").isNotNull(), "on").when(F.col("m1").isNotNull(), state).otherwise("off").alias("state"))


def toggle(states: DataFrame, module_id: str) -> DataFrame:
    """off -> on -> partial -> off for one module of (module_id, state)."""
    turned = F.when(F.col("state") == "off", "on").when(F.col("state") == "on", "partial").otherwise("off")
    return states.withColumn("state", F.when(F.col("module_id") == module_id, turned).otherwise(F.col("state")))


def set_all(g: CausalGraph, state: str) -> DataFrame:
    return g.nodes.select("module_id").distinct().withColumn("state", F.lit(state))


def back_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges that don't lead to a later layer of layers(id, layer)."""
    a, b = layers.select(F.col("id").alias("i1"), F.col("layer").alias("l1")), layers.select(F.col("id").alias("i2"), F.col("layer").alias("l2"))
    return edges.join(a, F.col("source") == F.col("i1")).join(b, F.col("target") == F.col("i2")).where("l1 >= l2").drop("i1", "i2", "l1", "l2")


def visible(g: CausalGraph, states: DataFrame, pinned: list[str], hide_boundary: bool) -> DataFrame:
    """Nodes that show: pinned ones, or those of modules on, less boundary nodes when these are collapsed."""
    on = states.where("state = 'on'").select(F.col("module_id").alias("m"))
    rows = g.nodes.join(on, F.col("module_id") == F.col("m"), "left")
    pin = F.col("id").isin(*pinned) if pinned else F.lit(False)
    shown = F.col("m").isNotNull() & (F.col("category") != "BOUNDARY" if hide_boundary else F.lit(True))
    return rows.where(pin | shown).select("id")


def pseudo_nodes(g: CausalGraph, visible_modules: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stands in for hidden modules between visible ones.

    (bridges(module_id, sources, targets): hidden modules reached from one visible module
    that lead to another; excluded(id): the edges between visible and bridging modules;
    entries(id): visible targets of bridges that keep no other edge from a visible node).
    """
    m = g.nodes.select(F.col("id").alias("n"), F.col("module_id").alias("m"))
    e = g.edges.join(m.toDF("n1", "sm"), F.col("source") == F.col("n1")).join(m.toDF("n2", "tm"), F.col("target") == F.col("n2")).select("id", "source", "target", "sm", "tm")
    seen = lambda c: F.col(c).isin(*visible_modules)
    into = e.where(seen("sm") & ~seen("tm")).groupBy(F.col("tm").alias("module_id")).agg(F.collect_set("sm").alias("sources"))
    out = e.where(~seen("sm") & seen("tm")).groupBy(F.col("sm").alias("module_id")).agg(F.collect_set("tm").alias("targets"))
    bridges = into.join(out, "module_id").where((F.size(F.array_except("targets", "sources")) > 0) | (F.size("sources") > 1))
    bridges = bridges.select("module_id", F.array_sort("sources").alias("sources"), F.array_sort("targets").alias("targets"))
    keys = bridges.select(F.col("module_id").alias("b"))
    excluded = e.where(seen("sm") & ~seen("tm")).join(keys, F.col("tm") == F.col("b"), "left_semi").unionByName(e.where(~seen("sm") & seen("tm")).join(keys, F.col("sm") == F.col("b"), "left_semi"))
    kept = e.where(seen("sm") & seen("tm")).select(F.col("target").alias("k"))
    entries = excluded.where(seen("tm")).select(F.col("target").alias("id")).distinct().join(kept, F.col("id") == F.col("k"), "left_anti")
    return bridges, excluded.select("id"), entries


def boundaries(g: CausalGraph) -> DataFrame:
    """(id, side): boundary nodes without an edge in are inputs, without an edge out outputs."""
    ins, outs = g.edges.select(F.col("target").alias("x")).distinct(), g.edges.select(F.col("source").alias("y")).distinct()
    rows = g.nodes.where("category = 'BOUNDARY'").join(ins, F.col("id") == F.col("x"), "left").join(outs, F.col("id") == F.col("y"), "left")
    side = F.when(F.col("x").isNull(), "input").when(F.col("y").isNull(), "output").otherwise("inner")
    return rows.select("id", side.alias("side"))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
