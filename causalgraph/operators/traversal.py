"""Paths, neighbourhoods, pathways, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..graph import CausalGraph
from ..plans.iterate import bfs, expand, relax
from ..plans.lineage import checkpoint


def _seed(g: CausalGraph, *ids: str) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([(i, i) for i in ids], "scope string, node string")


def _reverse(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def attributes(g: CausalGraph, paths: DataFrame) -> DataFrame:
    """paths(pid, path) with edges (ids along the path), strengths, and the weakest link: the first of least strength."""
    hops = paths.select("pid", F.posexplode("path").alias("pos", "u"))
    hops = hops.withColumn("v", F.lead("u").over(W.partitionBy("pid").orderBy("pos"))).where("v is not null")
    rep = g.edges_rep.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("id").alias("eid"), "strength", "distance", "conf_rank", "is_inhibitory")
    hops = hops.join(rep, (F.col("u") == F.col("s")) & (F.col("v") == F.col("t")), "left")
    got = hops.groupBy("pid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "eid"))), lambda x: x["eid"]).alias("edges"),
        F.min(F.struct("strength", "pos", "eid"))["eid"].alias("weakest_link"),
        F.min("strength").alias("bottleneck"), F.sum("distance").alias("distance"),
    )
    return paths.join(got, "pid", "left")


def shortest_path(g: CausalGraph, source: str, target: str) -> DataFrame:
    """(path, edges, total_weight, weakest_link): fewest edges, the smallest node path of those; no row if unreachable.

    From a node to itself the path is the node, known or not, with weight 0.
    """
    found = bfs(g.pairs(), _seed(g, source)).where(F.col("node") == target).select(F.lit(1).alias("pid"), "path", F.col("depth").cast("double").alias("total_weight"))
    return attributes(g, found).select("path", "edges", "total_weight", "weakest_link")


def shortest_path_weighted(g: CausalGraph, source: str, target: str) -> DataFrame:
    """Least sum of distances (a true minimum), over the latest edge of each pair."""
    edges = g.edges_rep.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("distance").alias("w"))
    found = relax(edges, _seed(g, source)).where(F.col("node") == target).select(F.lit(1).alias("pid"), "path", F.col("cost").alias("total_weight"))
    return attributes(g, found).select("path", "edges", "total_weight", "weakest_link")


def strongest_path(g: CausalGraph, source: str, target: str) -> DataFrame:
    """Greatest least strength; infinite from a node to itself."""
    edges = g.edges_rep.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("strength").alias("w"))
    found = relax(edges, _seed(g, source), widest=True).where(F.col("node") == target).select(F.lit(1).alias("pid"), "path", F.col("cost").alias("total_weight"))
    return attributes(g, found).select("path", "edges", "total_weight", "weakest_link")


def all_simple_paths(g: CausalGraph, source: str, target: str, max_depth: int = 8) -> DataFrame:
    """(path, edges, total_weight, weakest_link) of each simple path of at most max_depth edges; parallel edges give paths of their own.

    Only nodes that lie on some walk from source to target are expanded.  None from a node to itself.
    """
    if source == target:
        none = g.nodes.where("false").select(F.lit(1).alias("pid"), F.array("id").alias("path"))
        return attributes(g, none).select("path", "edges", F.col("distance").alias("total_weight"), "weakest_link")
    ahead = bfs(g.pairs(), _seed(g, source), max_depth).select(F.col("node").alias("n1"), F.col("depth").alias("d1"))
    back = bfs(_reverse(g.pairs()), _seed(g, target), max_depth).select(F.col("node").alias("n2"), F.col("depth").alias("d2"))
    useful = checkpoint(ahead.join(back, F.col("n1") == F.col("n2")).where(F.col("d1") + F.col("d2") <= max_depth).select(F.col("n1").alias("k")))
    edges = g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("id").alias("eid"))
    edges = edges.join(useful, F.col("src") == F.col("k"), "left_semi").join(useful, F.col("dst") == F.col("k"), "left_semi")
    paths = expand(edges, _seed(g, source).select("node"), max_depth, stop_at=target).where(F.col("last") == target)
    paths = checkpoint(paths.select(F.xxhash64("path", "eids").alias("pid"), "path", "eids"))
    return attributes(g, paths).select("path", F.col("eids").alias("edges"), F.col("distance").alias("total_weight"), "weakest_link").orderBy(F.size("path"), "path")


def k_hop(g: CausalGraph, start: str, depth: int, forward: bool = True) -> DataFrame:
    """(node, depth) within `depth` edges of the start, which has depth 0."""
    pairs = g.pairs() if forward else _reverse(g.pairs())
    return bfs(pairs, _seed(g, start), depth).select("node", "depth")


def neighborhood(g: CausalGraph, start: str, depth: int = 3) -> DataFrame:
    """(node, upstream, downstream, bidirectional) within the depth, without the start."""
    up = k_hop(g, start, depth, forward=False).where("depth > 0").select("node", F.lit(True).alias("u"))
    down = k_hop(g, start, depth).where("depth > 0").select("node", F.lit(True).alias("d"))
    rows = up.join(down, "node", "full").where(F.col("node") != start)
    u, d = F.coalesce("u", F.lit(False)), F.coalesce("d", F.lit(False))
    return rows.select("node", u.alias("upstream"), d.alias("downstream"), (u & d).alias("bidirectional"))


def pathway(g: CausalGraph, targets: list[str], depth: int = 2) -> dict[str, DataFrame]:
    """The surroundings of treatment targets: upstream, downstream, edges, modules.

    Targets stay as given, known or not.  Edges are those between targets and, for each
    node reached, the one edge by which it was reached: from the least node of the depth
    before, the latest of parallel edges.
    """
    spark = g.edges.sparkSession
    seeds = spark.createDataFrame([("t", t) for t in targets], "scope string, node string")
    wanted = spark.createDataFrame([(t,) for t in targets], "t string")
    out: dict[str, DataFrame] = {}
    found = []
    for name, pairs in (("upstream", _reverse(g.pairs())), ("downstream", g.pairs())):
        reach = checkpoint(bfs(pairs, seeds, depth).select("node", "depth"))
        out[name] = reach.where("depth > 0").select(F.col("node").alias("id"))
        a, b = reach.toDF("p", "dp"), reach.toDF("c", "dc")
        ends = ("target", "source") if name == "upstream" else ("source", "target")
        step = g.edges_rep.join(a, F.col(ends[0]) == F.col("p")).join(b, F.col(ends[1]) == F.col("c")).where("dc = dp + 1")
        found.append(step.groupBy("c").agg(F.min(F.struct("p", "id"))["id"].alias("id")).select("id"))
    between = g.edges.join(wanted, F.col("source") == F.col("t"), "left_semi").join(wanted, F.col("target") == F.col("t"), "left_semi").select("id")
    out["edges"] = between.union(found[0]).union(found[1]).distinct()
    known = wanted.select(F.col("t").alias("id")).union(out["upstream"]).union(out["downstream"])
    out["modules"] = g.nodes.join(known.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_semi").select("module_id").distinct()
    return out


def view_pathway(g: CausalGraph, targets: list[str], depth: int = 3) -> dict[str, DataFrame]:
    """As `pathway`, with unknown targets dropped and the induced edges, the latest of each pair."""
    spark = g.edges.sparkSession
    wanted = spark.createDataFrame([("t", t) for t in targets], "scope string, node string")
    known = checkpoint(wanted.join(g.nodes.select(F.col("id").alias("node")), "node", "left_semi").select("scope", "node"))
    up = bfs(_reverse(g.pairs()), known, depth).where("depth > 0").select(F.col("node").alias("id"))
    down = bfs(g.pairs(), known, depth).where("depth > 0").select(F.col("node").alias("id"))
    every = checkpoint(known.select(F.col("node").alias("k")).union(up).union(down).distinct())
    edges = g.edges_rep.join(every, F.col("source") == F.col("k"), "left_semi").join(every, F.col("target") == F.col("k"), "left_semi").select("id")
    modules = g.nodes.join(every, F.col("id") == F.col("k"), "left_semi").select("module_id").distinct()
    return {"targets": known.select(F.col("node").alias("id")), "upstream": up, "downstream": down, "edges": edges, "modules": modules}


def redundant_edges(g: CausalGraph, max_depth: int = 4, mode: str = "bottleneck") -> DataFrame:
    """(id, ord) of edges whose ends another path of at most max_depth edges joins.

    bottleneck: a path none of whose edges is weaker than the edge itself; as_built: any
    path.  The other path has two edges or more and doesn't pass the edge's ends.
    """
    if mode not in ("bottleneck", "as_built"):
        raise ValueError(mode)
    rank = F.col("conf_rank") if mode == "bottleneck" else F.lit(0)
    best = checkpoint(g.edges.groupBy(F.col("source").alias("u"), F.col("target").alias("v")).agg(F.min(rank).alias("r")))
    # For each edge's source, the least rank that suffices to reach a node in so many edges:
    # nodes before the edge's end may repeat, as a shorter path without them exists then.
    own = g.edges.where("source <> target").select(F.col("id").alias("eid"), F.col("source").alias("s"), F.col("target").alias("t"), rank.alias("limit"))
    front = own.join(best, F.col("s") == F.col("u")).where("v <> t and v <> s and r <= limit").select("eid", "s", "t", "limit", F.col("v").alias("at")).distinct()
    front, hits = checkpoint(front), None
    for _ in range(2, max_depth + 1):
        step = front.join(best, F.col("at") == F.col("u")).where("r <= limit and v <> s")
        hit = step.where("v = t").select("eid").distinct()
        hits = hit if hits is None else hits.union(hit)
        front = checkpoint(step.where("v <> t").select("eid", "s", "t", "limit", F.col("v").alias("at")).distinct())
        if not front.head(1):
            break
    if hits is None:
        return g.edges.where("false").select("id", "ord")
    return g.edges.join(hits.distinct(), F.col("id") == F.col("eid"), "left_semi").select("id", "ord").orderBy("ord")


def reachability(g: CausalGraph, pairs: list[tuple[str, str]]) -> DataFrame:
    """(start, end, reachable, hops) for each pair, by one search with the starts as scopes."""
    spark = g.edges.sparkSession
    asked = spark.createDataFrame(pairs, "start string, end string")
    reach = bfs(g.pairs(), asked.select(F.col("start").alias("scope"), F.col("start").alias("node"))).select(F.col("scope").alias("s"), F.col("node").alias("n"), "depth")
    rows = asked.join(reach, (F.col("start") == F.col("s")) & (F.col("end") == F.col("n")), "left")
    return rows.select("start", "end", F.col("depth").isNotNull().alias("reachable"), F.col("depth").alias("hops"))


def connected_nodes(g: CausalGraph, start: str) -> DataFrame:
    """(node): what is joined to the start by edges of either direction, itself included."""
    both = g.pairs().union(_reverse(g.pairs()))
    return bfs(both, _seed(g, start)).select("node")
