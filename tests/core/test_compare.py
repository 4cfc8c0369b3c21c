from causalgraph.operators import curation as D
from causalgraph.sources import documents as SRC

from .fixtures import build


def test_compare_graphs_counts_ids_and_pairs(spark):
    old = build(spark, "a:M b:M c:M", "a>b:L1 a>b:L2 b>c:L1")
    new = build(spark, "a:M b:M d:M", "a>b:L1 a>d:L1")
    got = {r.kind: tuple(r)[1:] for r in D.compare_graphs(old, new).collect()}
    assert got == {"nodes": (3, 3, 2, 1, 1), "edges": (3, 2, 2, 1, 0), "pairs": (2, 2, 1, 1, 1)}


def test_compare_with_an_empty_graph(spark):
    g = build(spark, "a:M b:M", "a>b:L1")
    none = g.update(g.nodes.where("false"), g.edges.where("false"))
    assert {tuple(r)[1:] for r in D.compare_graphs(none, none).collect()} == {(0, 0, 0, 0, 0)}
    assert {r.kind: tuple(r)[1:] for r in D.compare_graphs(g, none).collect()} == {"nodes": (2, 0, 0, 2, 0), "edges": (1, 0, 0, 1, 0), "pairs": (1, 0, 0, 1, 0)}


def test_summary(spark):
    g = build(spark, "a:M b:M c:M", "a>b:L1 a>a:L2")
    assert tuple(D.summary(g).first()) == (3, 2, 1, 33.3, 0.67, 0, 0.0)
    none = g.update(g.nodes.where("false"), g.edges.where("false"))
    assert tuple(D.summary(none).first()) == (0, 0, 0, None, None, 0, None)


def test_most_cited(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", None), ("e", 1)], "id string, value int")
    assert [tuple(r) for r in D.most_cited(rows, 3).orderBy("place").collect()] == [(1, "c", 5), (2, "a", 2), (3, "b", 2)]
    assert D.most_cited(rows.where("false")).count() == 0


def test_coordinates(spark):
    assert sorted(map(tuple, SRC.coordinates(spark, {"a": (1, 2), "b": (0.5, -1)}).collect())) == [("a", 1.0, 2.0), ("b", 0.5, -1.0)]
    assert SRC.coordinates(spark, {}).count() == 0
