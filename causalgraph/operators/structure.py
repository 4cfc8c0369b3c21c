"""Feedback loops, components, communities, robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CausalGraph
from ..plans.iterate import bfs, components, expand
from ..plans.lineage import checkpoint


def strong_components(g: CausalGraph) -> DataFrame:
    """(node, component): the least node that each node reaches and is reached from.

    Forward and backward least labels, in turn, on what is left: a node whose label is
    its own in both directions' fixpoints heads a component.
    """
    nodes = checkpoint(g.nodes.select(F.col("id").alias("node")))
    pairs = checkpoint(g.pairs().where("src <> dst").distinct())
    done = None
    while nodes.head(1):
        # Colour: the least node that reaches each node.
        color = checkpoint(nodes.select("node", F.col("node").alias("c")))
        while True:
            got = pairs.join(color.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            step = checkpoint(color.join(got, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("n"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            color = step.select("node", F.col("n").alias("c"))
            if not step.where("moved").head(1):
                break
        # Within a colour, what reaches its head forms its component.
        cs, cd = color.toDF("src", "cs"), color.toDF("dst", "cd")
        inner = pairs.join(cs, "src").join(cd, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        heads = color.where("node = c").select(F.col("c").alias("scope"), "node")
        scc = checkpoint(bfs(inner, heads).select("node", F.col("scope").alias("component")))
        done = scc if done is None else done.unionByName(scc)
        nodes = checkpoint(nodes.join(scc.select("node"), "node", "left_anti"))
        pairs = checkpoint(pairs.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))
    return nodes.withColumn("component", F.col("node")) if done is None else done


def feedback_loops(g: CausalGraph, max_length: int = 6) -> DataFrame:
    """(loop_id, nodes, edges, polarity, min_confidence) of simple cycles with 2 to max_length nodes.

    Each cycle begins at its least node.  Only strongly connected components of two or
    more nodes are searched.  Reinforcing: an even number of inhibitory edges.
    """
    scc = strong_components(g)
    big = checkpoint(scc.join(scc.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col("component") == F.col("c"), "left_semi"))
    rep = g.edges_rep.where("source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("id").alias("eid"), "is_inhibitory", "conf_rank")
    a, b = big.toDF("src", "ca"), big.toDF("dst", "cb")
    inner = checkpoint(rep.join(a, "src").join(b, "dst").where("ca = cb").drop("ca", "cb"))
    paths = expand(inner, big.select("node"), max_length - 1, ordered=True) if max_length >= 2 else big.where("false").select(F.array("node").alias("path"), F.array("node").alias("eids"), F.col("node").alias("last"))
    close = inner.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("eid").alias("back"))
    loops = paths.join(close, (F.col("last") == F.col("s")) & (F.get("path", F.lit(0)) == F.col("d"))).select("path", F.concat("eids", F.array("back")).alias("eids"))
    loops = checkpoint(loops.select(F.array_join("path", ">").alias("loop_id"), F.col("path").alias("nodes"), F.col("eids").alias("edges")))
    facts = loops.select("loop_id", F.explode("edges").alias("eid")).join(inner.select("eid", "is_inhibitory", "conf_rank"), "eid")
    facts = facts.groupBy("loop_id").agg((F.sum(F.col("is_inhibitory").cast("int")) % 2).alias("odd"), F.max("conf_rank").alias("worst"))
    rows = loops.join(facts, "loop_id")
    return rows.select("loop_id", "nodes", "edges", F.when(F.col("odd") == 0, "Reinforcing").otherwise("Balancing").alias("polarity"), F.concat(F.lit("L"), F.col("worst")).alias("min_confidence")).orderBy(F.size("nodes"), "nodes")


def loops_by_node(loops: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Curated loops(id, edge_ids) with an edge at the node."""
    at = edges.where((F.col("source") == node_id) | (F.col("target") == node_id)).select(F.col("id").alias("e"))
    hit = loops.select("id", F.explode("edge_ids").alias("e")).join(at, "e", "left_semi").select("id").distinct()
    return loops.join(hit, "id", "left_semi")


def weak_components(ids: DataFrame, pairs: DataFrame, closed: bool = False) -> DataFrame:
    """(node, component) of nodes(id) under pairs(src, dst) of either direction; closed: all ends are among the ids."""
    scope = F.lit(0).alias("scope")
    return components(ids.select(scope, F.col("id").alias("node")), pairs.select(scope, F.col("src").alias("a"), F.col("dst").alias("b")), closed).drop("scope")


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of a filtered view, largest first."""
    got = weak_components(nodes, edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return got.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "component")


def removal_impact(g: CausalGraph, ids: list[str] | None = None) -> DataFrame:
    """(removed, components_before, components_after, largest_component_size, largest_component_exact) of taking out each node.

    largest_component_size is the customary upper bound (n - 1) - (components_after - 1),
    0 for a single node.  All removals run as scopes of one search.
    """
    nodes = g.nodes.select(F.col("id").alias("node"))
    gone = nodes.toDF("scope") if ids is None else nodes.where(F.col("node").isin(*ids)).toDF("scope")
    rest = gone.crossJoin(nodes).where("scope <> node")
    pairs = gone.crossJoin(g.pairs().distinct().toDF("a", "b")).where("scope <> a and scope <> b")
    after = components(rest, pairs).groupBy("scope", "component").agg(F.count(F.lit(1)).alias("size"))
    after = after.groupBy("scope").agg(F.count(F.lit(1)).alias("after"), F.max("size").alias("exact"))
    before = F.broadcast(weak_components(g.nodes, g.pairs()).agg(F.count_distinct("component").alias("before"), F.count(F.lit(1)).alias("n")))
    rows = gone.join(after, "scope", "left").crossJoin(before)
    ca = F.coalesce("after", F.lit(0))
    return rows.select(F.col("scope").alias("removed"), F.col("before").alias("components_before"), ca.alias("components_after"), F.greatest(F.lit(0), F.col("n") - F.greatest(ca, F.lit(1))).alias("largest_component_size"), F.coalesce("exact", F.lit(0)).alias("largest_component_exact"))


def ranked_removal_impact(g: CausalGraph) -> DataFrame:
    return removal_impact(g).orderBy(F.col("components_after").desc(), "largest_component_size", "removed")


def communities(g: CausalGraph, max_iter: int = 100) -> DataFrame:
    """(node_id, community) by label propagation, made deterministic.

    In each round every node takes the label most frequent among its neighbours of both
    directions and itself, the least of several, all at once.
    """
    both = checkpoint(g.pairs().union(g.pairs().select("dst", "src")).toDF("node", "other").union(g.nodes.select("id", "id").toDF("node", "other")))
    label = checkpoint(g.nodes.select(F.col("id").alias("node"), F.col("id").alias("label")))
    for _ in range(max_iter):
        votes = both.join(label.toDF("other", "l"), "other").groupBy("node", "l").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("k"), "l"))["l"].alias("new"))
        step = checkpoint(label.join(best, "node").select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        label = step.drop("moved")
        if not step.where("moved").head(1):
            break
    least = label.groupBy("label").agg(F.min("node").alias("community"))
    return label.join(least, "label").select(F.col("node").alias("node_id"), "community")
