import pytest
from pyspark.sql import functions as F

from causalgraph.functions import confidence as K
from causalgraph.graph import GraphError
from causalgraph.operators import basic as B
from causalgraph.operators import centrality as A
from causalgraph.operators import structure as L
from causalgraph.operators import traversal as P

from .fixtures import build, graph

BTW = {
    "diamond": dict(a=(0, 0, 0.75, 0.137504), b=(0.083333, 0.166667, 0.333333, 0.195944), c=(0.083333, 0, 0.333333, 0.195944), d=(0, 0, 0, 0.470608)),
    "shortcut": dict(a=(0, 0, 0.75, 0.120452), b=(0, 0.333333, 0.444444, 0.171644), c=(0.333333, 0.333333, 0.333333, 0.317542), d=(0, 0, 0, 0.390362)),
    "pathway": dict(upstream1=(0, 0, 0.266667, 0.052048), upstream2=(0.1, 0.1, 0.25, 0.096289), target=(0.266667, 0.266667, 0.222222, 0.215739), downstream1=(0.166667, 0.166667, 0.166667, 0.235427), downstream2=(0, 0, 0, 0.252160), sidenode=(0.1, 0.1, 0.25, 0.096289), isolated=(0, 0, 0.266667, 0.052048)),
}


@pytest.mark.parametrize("name", BTW)
def test_centrality_values(spark, name):
    g = graph(spark, name).stored()
    got = [A.betweenness(g), A.betweenness(g, weighted=True), A.closeness(g), A.pagerank(g.nodes, g.pairs())]
    for k, df in enumerate(got):
        want = {n: v[k] for n, v in BTW[name].items()}
        assert {r.node_id: r.score for r in df.collect()} == pytest.approx(want, abs=2e-6), k


def test_degree_counts_parallel_edges_and_loops(spark):
    g = build(spark, "a:M b:M c:M", "a>b:L1 a>b:L2 c>c:L3")
    got = {r.node_id: (r.in_degree, r.out_degree, r.total, r.normalized) for r in A.degree(g).collect()}
    assert got == {"a": (0, 2, 2, 1.0), "b": (2, 0, 2, 1.0), "c": (1, 1, 2, 1.0)}


def test_parallel_edges_weigh_in_betweenness(spark):
    g = build(spark, "a:M b:M c:M d:M", "a>b:L1 a>b:L1 b>d:L1 a>c:L1 c>d:L1").stored()
    got = {r.node_id: r.score for r in A.betweenness(g).collect()}
    assert got["b"] == pytest.approx(2 / 3 / 6) and got["c"] == pytest.approx(1 / 3 / 6)


def test_weighted_path_is_the_least(spark):
    g = graph(spark, "shortcut").stored()
    r = P.shortest_path_weighted(g, "a", "d").first()
    assert r.path == ["a", "b", "c", "d"] and r.total_weight == pytest.approx(4.423224, abs=1e-6)
    r = P.strongest_path(g, "a", "d").first()
    assert (r.path, r.total_weight, r.weakest_link) == (["a", "b", "c", "d"], 0.55, "e2")
    r = P.shortest_path(g, "a", "d").first()
    assert (r.path, r.edges, r.total_weight, r.weakest_link) == (["a", "c", "d"], ["e3", "e4"], 2.0, "e3")
    assert P.shortest_path(g, "d", "a").count() == 0
    assert P.strongest_path(g, "a", "a").first().total_weight == float("inf")
    assert P.shortest_path(g, "zz", "zz").first().path == ["zz"]
    paths = [(r.path, round(r.total_weight, 6)) for r in P.all_simple_paths(g, "a", "d").collect()]
    assert paths == [(["a", "c", "d"], 4.761905), (["a", "b", "c", "d"], 4.423224)]
    assert P.all_simple_paths(g, "a", "a").count() == 0


def test_redundancy(spark):
    g = graph(spark, "shortcut").stored()
    for mode in ("bottleneck", "as_built"):
        assert [r.id for r in P.redundant_edges(g, 4, mode).collect()] == ["e3"]
        assert P.redundant_edges(g, 1, mode).count() == 0
    strong = build(spark, "a:M b:M c:M", "a>b:L2 b>c:L6 a>c:L3").stored()
    assert P.redundant_edges(strong).count() == 0 and P.redundant_edges(strong, mode="as_built").count() == 1


def test_pathways(spark):
    g = graph(spark, "pathway").stored()
    ids = lambda df: {r[0] for r in df.collect()}
    p = P.pathway(g, ["target"], 2)
    assert ids(p["upstream"]) == {"upstream1", "upstream2", "sidenode", "isolated"} and ids(p["downstream"]) == {"downstream1", "downstream2"}
    assert ids(p["modules"]) == {"M01", "M02", "M03", "M04"} and ids(p["edges"]) == {f"e{i}" for i in range(1, 7)}
    p = P.pathway(g, ["target"], 1)
    assert "upstream1" not in ids(p["upstream"]) and "downstream2" not in ids(p["downstream"])
    assert ids(P.view_pathway(g, ["target", "nobody"], 1)["targets"]) == {"target"}
    n = {r.node: r for r in P.neighborhood(graph(spark, "triangle").stored(), "a", 3).collect()}
    assert n["b"].bidirectional and n["c"].bidirectional and "a" not in n


def test_loops(spark):
    r = L.feedback_loops(graph(spark, "triangle").stored(), 5).collect()
    assert [(x.nodes, x.polarity) for x in r] == [(["a", "b", "c"], "Reinforcing")]
    assert L.feedback_loops(graph(spark, "triangle").stored(), 2).count() == 0
    assert [x.polarity for x in L.feedback_loops(graph(spark, "balancing").stored()).collect()] == ["Balancing"]
    assert L.feedback_loops(build(spark, "a:M b:M", "a>a:L1 a>b:L1").stored()).count() == 0


def test_components_and_communities(spark):
    comm = {r.node_id: r.community for r in L.communities(graph(spark, "islands")).collect()}
    assert comm["a"] == comm["b"] != comm["c"] == comm["d"]
    r = L.removal_impact(graph(spark, "bridge").stored(), ["b"]).first()
    assert (r.components_before, r.components_after) == (1, 2)
    after = {r.removed: (r.components_after, r.largest_component_size) for r in L.ranked_removal_impact(graph(spark, "pathway").stored()).collect()}
    assert after == dict(upstream1=(1, 6), upstream2=(2, 5), target=(3, 4), downstream1=(2, 5), downstream2=(1, 6), sidenode=(2, 5), isolated=(1, 6))
    one = L.removal_impact(build(spark, "a:M", "a>a:L1").stored()).first()
    assert (one.components_after, one.largest_component_size) == (0, 0)
    scc = {r.node: r.component for r in L.strong_components(build(spark, "a:M b:M c:M d:M e:M", "b>c:L1 c>b:L1 a>b:L1 d>e:L1 e>d:L1 c>d:L1").stored()).collect()}
    assert scc == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "d"}


def test_connectivity_and_modularity(spark):
    rows = {(r.source_module, r.target_module): (r.edges, r.avg_confidence) for r in A.module_connectivity(graph(spark, "cross")).collect()}
    assert rows["M01", "M02"] == (1, "0.70") and rows["M02", "M01"] == (0, "0")
    g = graph(spark, "islands")
    c = L.communities(g)
    assert A.modularity(g, c).first()[0] == pytest.approx(0.5) and A.modularity(g, c, standard=True).first()[0] == pytest.approx(0.5)


def test_filters(spark):
    g = graph(spark, "pathway")
    assert [r.id for r in B.filter_edges_by_confidence(g, "L3").collect()] == ["e1", "e2", "e3"]
    sub = g.subgraph(spark.createDataFrame([("target",), ("downstream1",), ("nobody",), ("target",)], "id string"))
    assert sub.nodes.count() == 2 and [r.id for r in sub.edges.collect()] == ["e3"]
    assert B.search(g, "t").count() == 0 and B.search(g, "target").count() == 1


def test_schemes(spark):
    rows = [("rct", "L1"), ("RCT", "L1"), ("mendelian_randomization", "L2"), ("knockout", "L3"), ("GWAS", "L3"), ("intervention_animal", "L4"), ("in_vitro", "L5"), ("cohort", "L6"), ("review", "L7"), ("odd", "L7"), (None, "L7")]
    df = spark.createDataFrame(rows, "m string, want string")
    assert df.where(K.ENGINE_DEFAULT.classify(F.col("m"), F.lit(None), F.lit("L7")) != F.col("want")).count() == 0
    least = K.Scheme("s", [K.Rule("L2", min_existing="L3")])
    got = [r[0] for r in spark.createDataFrame([("L2",), ("L3",), ("L4",), (None,)], "e string").select(least.classify(F.lit("x"), F.lit("1"), F.col("e"))).collect()]
    assert got == ["L2", "L2", "L7", "L7"]
    g = build(spark, "a:M b:M", "a>b:L7", scheme=K.Scheme("k", [K.Rule("L3", ())]), weights={"L3": 0.99})
    r = g.edges.first()
    assert (r.causal_confidence, r.strength) == ("L3", 0.99)


def test_bad_graphs_are_refused(spark):
    with pytest.raises(GraphError, match="node"):
        build(spark, "a:M", "missing>a:L1", check=True)
    with pytest.raises(GraphError, match="relation"):
        build(spark, "a:M b:M", "a>b:L1:heals", check=True)


def test_representative_edge_is_the_latest(spark):
    g = build(spark, "a:M b:M", "a>b:L1 a>b:L6")
    assert [r.id for r in B.edge_between(g, "a", "b").collect()] == ["e2"]
    assert [r.edge_id for r in B.successors(g, "a").collect()] == ["e2", "e1"]


def test_empty_graph(spark):
    g = build(spark, "a:M b:M", "a>b:L1").subgraph(spark.createDataFrame([], "id string"))
    assert A.degree(g).count() == 0 and A.pagerank(g.nodes, g.pairs()).count() == 0 and L.strong_components(g).count() == 0 and L.communities(g).count() == 0
