"""Degree, betweenness, closeness, PageRank, module connectivity, framework counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..graph import CausalGraph
from ..plans.iterate import bfs, relax, slices
from ..plans.lineage import checkpoint


def degree_of(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """In, out, total and normalised degree with multiplicity; pairs(src, dst).  Isolated nodes count 0."""
    ends = pairs.select(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pairs.select(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    # One shuffle over both ends together instead of one for each.
    rows = ids.select(F.col("id").alias("n"), F.lit(0).alias("i"), F.lit(0).alias("o")).withColumn("own", F.lit(1)).unionByName(ends.withColumn("own", F.lit(0)))
    sums = rows.groupBy(F.col("n").alias("node_id")).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.max("own").alias("own")).where("own = 1").drop("own")
    n = F.broadcast(ids.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("m")))
    total = F.col("in_degree") + F.col("out_degree")
    return sums.crossJoin(n).select("node_id", "in_degree", "out_degree", total.alias("total"), (total / F.col("m")).alias("normalized"))


def degree(g: CausalGraph) -> DataFrame:
    return degree_of(g.nodes, g.pairs()).orderBy(F.col("total").desc(), "node_id")


def node_degree(g: CausalGraph, node_id: str) -> DataFrame:
    """(id, degree) of one node, 0 for one without edges."""
    ends = (F.col("source") == node_id).cast("bigint") + (F.col("target") == node_id).cast("bigint")
    return g.edges.agg(F.coalesce(F.sum(ends), F.lit(0)).alias("degree")).select(F.lit(node_id).alias("id"), "degree")


def betweenness(g: CausalGraph, weighted: bool = False, tolerance: float = 1e-10) -> DataFrame:
    """Directed betweenness over (n-1)(n-2), parallel edges counting apart.

    Brandes by levels, for all starts at once: path counts flow forward from level to
    level, dependencies back.  With weights a level is the longest run of edges on the
    graph of shortest paths, whose edges satisfy d(u) + w = d(v) within the tolerance.
    """
    seeds = g.nodes.select(F.col("id").alias("scope"), F.col("id").alias("node"))
    if weighted:
        edges = g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("distance").alias("w"))
        dist = relax(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), seeds).select("scope", "node", F.col("cost").alias("d"))
        on = F.abs(F.col("d1") + F.col("w") - F.col("d2")) < tolerance
    else:
        edges = g.pairs().withColumn("w", F.lit(1.0))
        dist = bfs(edges, seeds).select("scope", "node", F.col("depth").cast("double").alias("d"))
        on = F.col("d1") + 1 == F.col("d2")
    a, b = dist.toDF("scope", "u", "d1"), dist.toDF("scope", "v", "d2")
    steps = a.join(edges.toDF("u", "v", "w"), "u").join(b, ["scope", "v"]).where(on & (F.col("u") != F.col("v")))
    steps = checkpoint(steps.groupBy("scope", "u", "v").agg(F.count(F.lit(1)).alias("m")))
    # Levels by the longest way, so that all predecessors of a level come before it.
    level = checkpoint(seeds.withColumn("level", F.lit(0)))
    front, depth = level, 0
    while True:
        depth += 1
        front = checkpoint(front.select("scope", F.col("node").alias("u")).join(steps, ["scope", "u"]).select("scope", F.col("v").alias("node"), F.lit(depth).alias("level")).distinct())
        if not front.head(1):
            break
        level = level.unionByName(front)
    level = checkpoint(level.groupBy("scope", "node").agg(F.max("level").alias("level")))
    lu, lv = level.toDF("scope", "u", "lu"), level.toDF("scope", "v", "lv")
    steps = checkpoint(steps.join(lu, ["scope", "u"]).join(lv, ["scope", "v"]))
    sigma = seeds.select("scope", "node", F.lit(1.0).alias("sigma"))
    for d in range(1, depth):
        got = steps.where(F.col("lv") == d).join(sigma.toDF("scope", "u", "s"), ["scope", "u"]).groupBy("scope", F.col("v").alias("node")).agg(F.sum(F.col("s") * F.col("m")).alias("sigma"))
        sigma = checkpoint(sigma.unionByName(got))
    parts = steps.join(sigma.toDF("scope", "u", "su"), ["scope", "u"]).join(sigma.toDF("scope", "v", "sv"), ["scope", "v"])
    parts = checkpoint(parts.select("scope", "u", "v", "lv", (F.col("m") * F.col("su") / F.col("sv")).alias("share")))
    # Dependencies from the last level back; a node's is final once all later levels are in.
    delta = None
    for d in range(depth - 1, 0, -1):
        here = parts.where(F.col("lv") == d)
        if delta is None:
            got = here.groupBy("scope", "u").agg(F.sum("share").alias("x"))
        else:
            held = delta.groupBy("scope", "node").agg(F.sum("x").alias("have"))
            got = here.join(held.withColumnRenamed("node", "v"), ["scope", "v"], "left").groupBy("scope", "u").agg(F.sum(F.col("share") * (1 + F.coalesce("have", F.lit(0.0)))).alias("x"))
        got = got.select("scope", F.col("u").alias("node"), "x")
        delta = checkpoint(got if delta is None else delta.unionByName(got))
    ids = g.nodes.select(F.col("id").alias("node_id"))
    n = F.broadcast(g.nodes.agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.when(F.col("n") <= 2, 1.0).otherwise((F.col("n") - 1) * (F.col("n") - 2)).alias("norm")))
    if delta is None:
        return ids.withColumn("score", F.lit(0.0))
    sums = delta.where("scope <> node").groupBy(F.col("node").alias("k")).agg(F.sum("x").alias("x"))
    return ids.join(sums, F.col("node_id") == F.col("k"), "left").crossJoin(n).select("node_id", (F.coalesce("x", F.lit(0.0)) / F.col("norm")).alias("score")).orderBy(F.round("score", 12).desc(), "node_id")


def closeness(g: CausalGraph) -> DataFrame:
    """(r / (n-1)) (r / sum of distances) over the r nodes reached by edges out; 0 if none is."""
    reach = bfs(g.pairs(), g.nodes.select(F.col("id").alias("scope"), F.col("id").alias("node"))).where("depth > 0")
    sums = reach.groupBy(F.col("scope").alias("k")).agg(F.count(F.lit(1)).alias("r"), F.sum("depth").alias("t"))
    n = F.broadcast(g.nodes.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("m")))
    score = F.col("r") / F.col("m") * (F.col("r") / F.col("t"))
    return g.nodes.select(F.col("id").alias("node_id")).join(sums, F.col("node_id") == F.col("k"), "left").crossJoin(n).select("node_id", F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.round("score", 12).desc(), "node_id")


def pagerank(ids: DataFrame, pairs: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, simple: bool = False) -> DataFrame:
    """Rank over pairs(src, dst) with multiplicity; what dangling nodes hold goes to all alike.

    Stops once the sum of changes is below `tol`; with tol None after exactly max_iter
    rounds.  The edges are grouped by source once, with their degree; a round
    is one join, in tasks of bounded size, and one aggregation.  simple: no pair is
    repeated, so pairs aren't counted.
    """
    ids = checkpoint(ids.select(F.col("id").alias("node")).distinct())
    n = ids.count()
    if n == 0:
        return ids.select(F.col("node").alias("node_id"), F.lit(0.0).alias("score"))
    many = pairs.where("src is not null")
    many = many.withColumn("m", F.lit(1)) if simple else many.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    links = checkpoint(many.withColumn("deg", F.sum("m").over(W.partitionBy("src"))).select("src", "dst", (F.col("m") / F.col("deg")).alias("share")))
    parts = slices(links.count())
    # The columns change places, as a join right over both shuffles would set their number anew.
    dealt = links.repartition(parts, "src").select("dst", "share", "src")
    sources = links.select(F.col("src").alias("node")).distinct()
    rank = ids.join(sources.withColumn("live", F.lit(True)), "node", "left").select("node", F.coalesce("live", F.lit(False)).alias("live"), F.lit(1.0 / n).alias("r"))
    rank = checkpoint(rank)
    for k in range(max_iter):
        loose = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(~F.col("live"), F.col("r"))), F.lit(0.0)).alias("loose")))
        flow = dealt.join(rank.select(F.col("node").alias("src"), "r").repartition(parts, "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("share")).alias("flow"))
        new = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / n)
        step = rank.join(flow, "node", "left").crossJoin(loose).select("node", "live", F.col("r").alias("old"), new.alias("r"))
        # Lineage is cut every second round when no test for the end is due.
        step = checkpoint(step) if tol is not None or k % 2 else step
        rank = step.drop("old")
        if tol is not None and step.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] < tol:
            break
    return rank.select(F.col("node").alias("node_id"), F.col("r").alias("score")).orderBy(F.round("score", 12).desc(), "node_id")


def module_connectivity(g: CausalGraph) -> DataFrame:
    """(source_module, target_module, edges, avg_confidence) for all pairs of modules; the mean strength as text of two digits, "0" for none."""
    m = g.nodes.select(F.col("id").alias("n"), F.col("module_id").alias("m"))
    e = g.edges.join(m.toDF("n1", "sm"), F.col("source") == F.col("n1")).join(m.toDF("n2", "tm"), F.col("target") == F.col("n2"))
    found = e.groupBy("sm", "tm").agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("a"))
    mods = g.nodes.select("module_id").distinct()
    full = mods.toDF("source_module").crossJoin(mods.toDF("target_module"))
    rows = full.join(found, (F.col("source_module") == F.col("sm")) & (F.col("target_module") == F.col("tm")), "left")
    return rows.select("source_module", "target_module", F.coalesce("n", F.lit(0)).alias("edges"), F.when(F.col("n") > 0, F.format_string("%.2f", F.round("a", 9))).otherwise("0").alias("avg_confidence")).orderBy("source_module", "target_module")


def modularity(g: CausalGraph, communities: DataFrame, standard: bool = False) -> DataFrame:
    """Q of communities(node_id, community): over the edges within (as_built), or over all pairs within (standard)."""
    m = F.broadcast(g.edges.agg(F.count(F.lit(1)).cast("double").alias("m")))
    c = communities.select(F.col("node_id").alias("n"), "community")
    e = g.edges.select("source", "target").join(c.toDF("source", "cs"), "source").join(c.toDF("target", "ct"), "target").where("cs = ct")
    kout = g.edges.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("ko"))
    kin = g.edges.groupBy(F.col("target").alias("t")).agg(F.count(F.lit(1)).alias("ki"))
    if standard:
        by = c.join(kout, F.col("n") == F.col("s"), "left").join(kin, F.col("n") == F.col("t"), "left").groupBy("community").agg(F.sum(F.coalesce("ko", F.lit(0))).alias("o"), F.sum(F.coalesce("ki", F.lit(0))).alias("i"))
        inner = e.groupBy(F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("e"))
        rows = by.join(inner, "community", "left").crossJoin(m)
        return rows.agg(F.coalesce(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.col("o") * F.col("i") / (F.col("m") * F.col("m"))), F.lit(0.0)).alias("modularity"))
    rows = e.join(kout, F.col("source") == F.col("s")).join(kin, F.col("target") == F.col("t")).crossJoin(m)
    return rows.agg(F.coalesce(F.sum((1 - F.col("ko") * F.col("ki") / F.col("m")) / F.col("m")), F.lit(0.0)).alias("modularity"))


def framework_stats(g: CausalGraph, loops: DataFrame | None = None) -> DataFrame:
    """(kind, value, n): nodes by category and role, edges by level, and curated loops(type) by type where given."""
    cat = g.nodes.groupBy(F.lit("category").alias("kind"), F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    role = g.nodes.select(F.explode("roles").alias("value")).groupBy(F.lit("role").alias("kind"), "value").agg(F.count(F.lit(1)).alias("n"))
    level = g.edges.groupBy(F.lit("level").alias("kind"), F.col("causal_confidence").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    stats = cat.unionByName(role).unionByName(level)
    return stats if loops is None else stats.unionByName(loops.groupBy(F.lit("loop").alias("kind"), F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n")))
