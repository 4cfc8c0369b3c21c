"""Queries whose tables grow: what they do once a row, once an edge, and in how many tasks."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from causalgraph import queries as core
from causalgraph.functions import scalars as S
from causalgraph.operators import centrality as A
from causalgraph.plans import iterate
from causalgraph.plans import projections as G
from causalgraph.plans.iterate import components

SF = "/root/testdata/sf0.001"


def test_tokens_once_a_row(spark):
    # Pairs outnumber rows: nothing is tokenised above the join.
    for name in ("k18_title_similarity", "k20_word_overlap"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above, join, below = plan.partition("Join ")
        assert join and "regexp_replace" not in above and "regexp_replace" in below


def test_pairs_are_dealt_to_all_cores(spark):
    # The parts are one small file; their pairs are many.
    df = entry.queries()["k20_word_overlap"](spark, SF)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_overlaps_as_one_pair_at_a_time(spark):
    texts = ["red bolt", "Red-bolt_7", "", "--", None, "ring 7 ring", "red bolt"]
    rows = spark.createDataFrame(list(enumerate(texts)), "a long, ta string")
    few = spark.createDataFrame([("x", "bolt red"), ("y", ""), ("z", None), ("w", "7 ring")], "b string, tb string")
    key = lambda df: sorted(((r.a, r.b, r.overlap) for r in df.collect()), key=repr)
    got = key(core._overlaps(spark, rows, few))
    assert len(got) == 28 and {g[2] for g in got} == {None, 0.0, 1.0, 1 / 3, 2 / 3}
    assert got == key(rows.crossJoin(few).select("a", "b", S.word_overlap(F.col("ta"), F.col("tb")).alias("overlap")))


def brute(nodes, edges):
    """Least node of each component, by union of sets."""
    at = {n: {n} for n in nodes}
    for s, a, b in edges:
        if (s, a) in at and (s, b) in at and at[s, a] is not at[s, b]:
            at[s, a] |= at[s, b]
            for n in at[s, b]:
                at[n] = at[s, a]
    return {(s, n, min(m for _, m in own)) for (s, n), own in at.items()}


def test_components_against_brute_force(spark):
    rng, nodes, edges = random.Random(7), [], []
    for s, m in enumerate((0, 15, 30, 60)):  # scattered, with loops, doubles and isolated nodes
        nodes += [(s, f"v{k:02d}") for k in range(50)]
        edges += [(s, f"v{rng.randrange(50):02d}", f"v{rng.randrange(50):02d}") for _ in range(m)]
    edges += edges[:9] + [(1, "v01", None), (None, "v01", "v02"), (1, "v01", "gone"), (1, "gone", "v02"), (1, "a", "v03")]
    path = [f"p{k:03d}" for k in range(200)]
    nodes += [(4, x) for x in path] + [(5, x) for x in path]
    edges += [(4, *x) for x in zip(path, path[1:])] + [(5, "p199", x) for x in path[:150]]
    # Stars whose centres are joined one by one, so that a level leaves work for the next.
    nodes += [(6, x) for x in (*path, *(f"q{k}" for k in range(6)), "z")]
    edges += [(6, f"q{k // 30}", x) for k, x in enumerate(path[:180])] + [(6, "z", f"p{k * 30 + 5:03d}") for k in range(5)]
    got = components(spark.createDataFrame(nodes + nodes[:5], "scope int, node string"), spark.createDataFrame(edges, "scope int, a string, b string")).collect()
    assert {tuple(r) for r in got} == brute(nodes, edges) and len(got) == len(nodes)


def test_ends_of_one_edge_meet_one_level(spark, monkeypatch):
    # Ten regions with 300 ends each: later levels write nothing of the size of the graph.
    sizes, real = [], iterate.checkpoint
    monkeypatch.setattr(iterate, "checkpoint", lambda df: sizes.append((out := real(df)).count()) or out)
    edges = [("r", f"n{k}") for k in range(10)] + [(f"n{k % 10}", f"o{k:04d}") for k in range(3000)]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("scope", F.lit(0))
    got = components(df.select("scope", F.col("a").alias("node")).union(df.select("scope", "b")), df)
    assert {r.component for r in got.collect()} == {"n0"} and got.count() == 3011
    assert max(sizes) == 3010 and sorted(sizes)[-2] < 100


def test_edges_a_task_are_bounded(spark, monkeypatch):
    # The tasks over edges become more with the table; what one of them groups or joins does not grow.
    monkeypatch.setattr(iterate, "EDGES_A_TASK", 100)
    nodes, edges = G.supply(spark, SF)
    assert edges.rdd.getNumPartitions() >= spark.read.parquet(f"{SF}/lineitem.parquet").count() / 100
    plans, real = [], A.checkpoint
    monkeypatch.setattr(A, "checkpoint", lambda df: plans.append((out := real(df), df._jdf.queryExecution().executedPlan().toString())[1]) or out)
    pairs = edges.toDF("src", "dst")
    got = A.pagerank(nodes, pairs, max_iter=2, tol=None, simple=True)
    parts = -(-pairs.count() // 100)
    assert parts > 8 and sum(f", {parts}), REPARTITION_BY_NUM" in p for p in plans) >= 1
    twice = A.pagerank(nodes, pairs.union(pairs), max_iter=2, tol=None)
    key = lambda df: {r.node_id: round(r.score, 12) for r in df.collect()}
    assert key(got) == key(twice) and abs(sum(key(got).values()) - 1) < 1e-6


def test_supply_pairs_are_distinct(spark):
    line = {(f"S{r.l_suppkey}", f"P{r.l_partkey}") for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()}
    got = G.supply(spark, SF)[1].collect()
    assert len(got) == len(line) and {tuple(r) for r in got} == line
