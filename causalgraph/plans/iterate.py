"""Loops over DataFrames: breadth-first search, relaxation, component labels, path expansion.

Every loop carries a `scope` column, so that many searches (one for each start, one for
each removed node) run as one plan.  Each round joins the frontier, not the visited set,
with the edges, and writes its state once; rounds are bounded by the graph's depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .lineage import checkpoint

#: Rows of a table of edges that a task sorts or groups at once.
EDGES_A_TASK = 500_000


def slices(rows: int) -> int:
    """Tasks for so many edges: their number grows with the table, not what one of them holds."""
    return max(1, -(-rows // EDGES_A_TASK))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(scope, node, depth, path): nodes reached over edges(src, dst) from seeds(scope, node).

    Depth 0 is the seed; path is the smallest of the shortest node paths.  An empty
    frontier ends the loop, so an unbounded search ends after the graph's depth.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = checkpoint(seeds.select("scope", "node").distinct().select("scope", "node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).groupBy("scope", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = checkpoint(step.join(seen.select("scope", "node"), ["scope", "node"], "left_anti").select("scope", "node", F.lit(depth).alias("depth"), "path"))
        if not front.head(1):
            break
        seen = checkpoint(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)
    return seen


def relax(edges: DataFrame, seeds: DataFrame, widest: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(scope, node, cost, path): cheapest paths over edges(src, dst, w), or widest ones (cost = least w on the path).

    Only labels that changed in a round go on to the next.  Ties: fewer nodes, then the
    smaller path.
    """
    edges = edges.select("src", "dst", "w")
    start = F.lit(float("inf")) if widest else F.lit(0.0)
    seen = checkpoint(seeds.select("scope", "node").distinct().select("scope", "node", start.alias("cost"), F.array("node").alias("path")))
    front = seen
    order = -F.col("cost") if widest else F.round("cost", 12)
    for _ in range(max_rounds):
        cost = F.least("cost", "w") if widest else F.col("cost") + F.col("w")
        step = front.join(edges, front["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select("scope", F.col("dst").alias("node"), cost.alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        both = seen.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.lit(True)))
        best = F.min(F.struct(order.alias("o"), F.size("path").alias("n"), "path", "new", "cost")).alias("x")
        both = checkpoint(both.groupBy("scope", "node").agg(best).select("scope", "node", "x.cost", "x.path", "x.new"))
        seen, front = both.drop("new"), both.where("new").drop("new")
        if not front.head(1):
            return seen
    raise RuntimeError("relaxation does not settle")


def components(nodes: DataFrame, edges: DataFrame, closed: bool = False) -> DataFrame:
    """(scope, node, component): least node of each weak component of edges(scope, a, b) over nodes(scope, node).

    Edges with an end that is no node don't count; closed: there are none, so they aren't
    looked for.  In a level every node with a smaller neighbour hangs itself under the
    least one, and the other edges go on between the roots; so nodes on one edge, most of
    a hierarchy, are done with in the first level.  Of the nodes with edges at most half
    are left after two levels; trees are cut short by pointer jumping.
    """
    key = ["scope", "node"]
    nodes = nodes.select(*key).where("scope is not null and node is not null")
    left = edges.select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not closed:
        for end in ("a", "b"):
            left = left.join(nodes.withColumnRenamed("node", end), ["scope", end], "left_semi")
    levels: list[DataFrame] = []
    by = W.partitionBy("scope", "b").orderBy("a")
    while True:
        left = left.where("a < b").select("scope", "a", "b", F.lag("a").over(by).alias("prev"), F.first("a").over(by).alias("low"))
        left = checkpoint(left.where("prev is null or prev < a").select("scope", "a", "b", "low"))
        hung = left.where("a = low").select("scope", F.col("b").alias("node"), F.col("low").alias("root"))
        rest = left.where("a > low").select("scope", "a", F.col("low").alias("b"))
        ends = rest.select("scope", F.col("a").alias("node")).union(rest.select("scope", "b")).withColumn("p", F.lit(0))
        while True:
            asked = hung.select("scope", F.col("root").alias("node"), F.lit(1).alias("p")).union(ends).groupBy(*key).agg(F.max("p").alias("p"))
            up = checkpoint(asked.join(hung, key).select("scope", "node", F.col("root").alias("top"), "p"))
            if not up.where("p = 1").head(1):
                break
            over = up.where("p = 1").select("scope", F.col("node").alias("root"), "top")
            hung = checkpoint(hung.join(over, ["scope", "root"], "left").select("scope", "node", F.coalesce("top", "root").alias("root")))
        levels.append(hung)
        if not rest.head(1):
            break
        for end in ("a", "b"):
            rest = rest.join(up.select("scope", F.col("node").alias(end), F.col("top").alias(f"r{end}")), ["scope", end], "left")
        ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        left = rest.select("scope", F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b"))
    least = levels.pop()
    while levels:
        hung = levels.pop()
        over = least.select("scope", F.col("node").alias("root"), F.col("root").alias("top"))
        least = hung.join(over, ["scope", "root"], "left").select("scope", "node", F.coalesce("top", "root").alias("root")).union(least)
    # A root is less than what hangs under it, so the minimum is the root where there is one.
    rows = nodes.select("scope", "node", F.col("node").alias("root"), F.lit(1).alias("own")).union(least.withColumn("own", F.lit(0)))
    return rows.groupBy(*key).agg(F.min("root").alias("component"), F.max("own").alias("own")).where("own = 1").drop("own")


def expand(edges: DataFrame, seeds: DataFrame, max_edges: int, stop_at: str | None = None, closing: bool = False, ordered: bool = False) -> DataFrame:
    """(path, eids, last): simple paths of 1..max_edges edges(src, dst, eid), parallel edges apart.

    Paths are not continued beyond `stop_at`.  closing: continue only with nodes
    greater than the first (`ordered`), so that each cycle is met once, at its least node.
    """
    edges = edges.select("src", "dst", "eid")
    front = checkpoint(seeds.select(F.array("node").alias("path"), F.array().cast("array<string>").alias("eids"), F.col("node").alias("last")))
    out = None
    for _ in range(max_edges):
        fresh = ~F.array_contains("path", F.col("dst"))
        if ordered:
            fresh = fresh & (F.col("dst") > F.get("path", F.lit(0)))
        live = front if stop_at is None else front.where(F.col("last") != stop_at)
        front = checkpoint(live.join(edges, live["last"] == edges["src"]).where(fresh).select(F.concat("path", F.array("dst")).alias("path"), F.concat("eids", F.array("eid")).alias("eids"), F.col("dst").alias("last")))
        if not front.head(1):
            break
        out = front if out is None else out.unionByName(front)
    return front.limit(0) if out is None else out
