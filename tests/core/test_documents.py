import json

import pytest
from pyspark.sql import functions as F

from causalgraph.functions import scalars as S
from causalgraph.graph import GraphError
from causalgraph.operators import curation as D
from causalgraph.operators import layout as Y
from causalgraph.sources import documents as SRC
from causalgraph.sources import exports as X
from causalgraph.streaming import updates as U

from .fixtures import build, graph

DOC = {
    "nodes": [{"id": "a", "label": "A", "category": "STOCK", "subtype": "x", "moduleId": "M", "description": "Test, with comma", "roles": ["R"]}, {"id": "b", "label": "B & <b>", "category": "BOUNDARY", "subtype": "", "moduleId": "M", "description": ""}],
    "edges": [{"id": "e", "source": "a", "target": "b", "relation": "inhibits", "moduleId": "M", "causalConfidence": "L3", "evidence": {"pmid": "7", "year": 2001, "firstAuthor": "Li"}}],
    "modules": [{"id": "M", "name": "Mod"}],
    "confidenceWeights": {"L3": 0.5},
}


def write(tmp_path, doc) -> str:
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc, indent=1))
    return str(p)


def test_json_document(spark, tmp_path):
    g = SRC.from_json(spark, write(tmp_path, DOC))
    r = g.edges.first()
    assert (r.pmid, r.year, r.first_author, r.strength, r.is_inhibitory) == ("7", 2001, "Li", 0.5, True)
    for change in ({"relation": "heals"}, {"target": "zz"}):
        bad = json.loads(json.dumps(DOC))
        bad["edges"][0].update(change)
        with pytest.raises(GraphError):
            SRC.from_json(spark, write(tmp_path, bad))


def test_simple_json(spark):
    df = spark.createDataFrame([(json.dumps({"nodes": [{"id": "x"}, {"id": "y", "name": "Why"}], "edges": [{"source": "x", "target": "y", "label": "l"}]}),)], "s string").select(F.from_json("s", SRC.SIMPLE).alias("d")).select("d.*")
    g = SRC.from_simple(df)
    assert [(r.id, r.relation, r.causal_confidence, r.key_insight) for r in g.edges.collect()] == [("e_x_y_0", "association", "L7", "l")]
    assert [r.id for r in g.modules.collect()] == ["default"]


def test_exports(spark, tmp_path):
    g = SRC.from_json(spark, write(tmp_path, DOC))
    doc = json.loads(X.node_link(g).first().value)
    assert doc["directed"] and len(doc["nodes"]) == 2 and doc["links"][0]["relation"] == "inhibits"
    back = SRC.parse_graphml(X.as_text(X.graphml(g)))
    assert {r.label for r in back.nodes.collect()} == {"A", "B & <b>"} and back.edges.first().relation == "inhibits"
    assert "Inhibits" in X.as_text(X.graphml(g, debug_names=True)).first().value
    assert 'weight="0.5"' in X.as_text(X.gexf(g)).first().value
    assert any('"Test, with comma"' in r.value for r in X.csv_nodes(g).collect())
    X.write_text(X.csv_nodes(g), f"{tmp_path}/csv")
    assert [r.value.split(",")[0] for r in spark.read.text(f"{tmp_path}/csv").collect()] == ["id", "a", "b"]
    m = X.adjacency_matrix(g, ["M"])
    assert m.columns == ["source", "a", "b"] and m.first().a == "—" and m.first().b == "-|L3"


def test_svg(spark):
    svg = '<svg><defs><g id="no" x="1"/></defs><g id="m" transform="matrix(1 0 0 1 5 6)"/><g id="t" transform="translate(3,4)"/><rect id="r" x="10" y="20" width="4" height="6"/><circle id="zero"/></svg>'
    got = {r.id: (r.x, r.y) for r in SRC.svg_positions(spark.createDataFrame([(svg,)], "value string")).collect()}
    assert got == {"m": (5.0, 6.0), "t": (3.0, 4.0), "r": (12.0, 23.0)}


def test_synthetic_graph(spark):
    g = SRC.synthetic(spark, 100)
    rows = g.edges.collect()
    assert len(rows) == 180 and len({(r.source, r.target) for r in rows}) == 180 and all(r.source != r.target for r in rows)
    assert [r.id for r in SRC.synthetic(spark, 100).edges.collect()] == [r.id for r in rows]
    g.validate()


def test_source_records_and_abstracts(spark):
    text = "export const x = [ { id: 'a_1', label: \"A {1}\", nested: { id: 'v', k: 2 } },\n { id: `b`, note: 'it\\'s' } ];"
    got = [r.record for r in SRC.source_records(spark.createDataFrame([(text,)], "value string")).orderBy("ord").collect()]
    assert [g["id"] for g in got] == ["v", "a_1", "b"] and got[1]["label"] == "A {1}" and got[2]["note"] == "it's"
    xml = "<X><PubmedArticle><PMID>5</PMID><AbstractText L='a'>One <i>two</i></AbstractText><AbstractText>three</AbstractText></PubmedArticle></X>"
    got = {r.pmid: r.abstract for r in SRC.abstracts(spark.createDataFrame([(xml,)], "value string"), spark.createDataFrame([("5",), ("6",)], "pmid string")).collect()}
    assert got == {"5": "One two three", "6": None}


def test_view_state(spark):
    df = spark.createDataFrame([('{"version":"1.1","evidenceFilter":"strong","hiddenModules":["a"]}',), ('{"evidenceFilter":"all"}',), ('{"version":"1","evidenceFilter":"odd"}',)], "s string")
    got = [r[0] for r in df.select(SRC.view_state(F.col("s"))).collect()]
    assert got[0].evidenceFilter == "strong" and got[1] is None and got[2].evidenceFilter is None
    back = X.view_state_json(df.limit(1).select(SRC.view_state(F.col("s")).alias("v")).select("v.*")).first().value
    assert json.loads(back)["version"] == "1.1"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.normalize_author(F.lit("JA Müller"))) == "muller" and one(S.normalize_author(F.lit("Li W."))) == "li"
    assert one(S.normalize_method(F.lit("animal, in_vitro"))) == "intervention_animal" and one(S.normalize_method(F.lit("odd"))) is None
    assert one(S.title_similarity(F.lit("Amyloid drives tau"), F.lit("Amyloid and more"))) == pytest.approx(0.5)
    assert one(S.extract_year(F.lit("Published 1999 Jan"))) == 1999 and one(S.extract_year(F.lit("no"))) is None
    assert [x.type for x in one(S.chemical_segments(F.lit("Ca^2+ H2O")))] == ["normal", "sup", "normal", "sub", "normal"]
    assert one(S.cns_mpo(F.lit(300.0), F.lit(None).cast("double"), F.lit(65.0), F.lit(0), F.lit(5), F.lit(10))) == pytest.approx(1 + 0.5 + 0.5 + 1 + 1 + 0)


def test_layout(spark):
    layers = Y.layers_of({"a": "STOCK", "b": "STOCK", "c": "STOCK"}, [("a", "b"), ("b", "c"), ("c", "a")])
    assert layers == {"a": 0, "b": 1, "c": 2}
    drawn = Y.layers_of({"s": "STOCK", "in": "BOUNDARY", "x": "STOCK", "y": "STOCK", "z": "STOCK"}, [("x", "y"), ("y", "z"), ("s", "z"), ("in", "z")])
    assert drawn["s"] == 1 and drawn["in"] == 0
    pos = {r.id: r for r in Y.flat_layout(graph(spark, "shortcut")).collect()}
    assert {pos[n].layer for n in "abcd"} == {0, 1, 2, 3} and pos["d"].y == 750.0 and any(r.is_ghost for r in pos.values())
    moved, boxes = Y.hierarchical_layout(graph(spark, "six"), Y.module_clusters(graph(spark, "six")))
    assert boxes.count() == 3 and moved.where("not is_ghost").count() == 6
    d = Y.diagnostics(graph(spark, "six"), Y.module_clusters(graph(spark, "six"))).first()
    assert (d.k, d.module_agreement, d.modules_split, d.cross_cluster_edge_ratio) == (3, 1.0, 0, 0.25)
    assert Y.eigengap([0, 0.1, 0.2, 0.9, 1.0], 10) == 3 and Y.merge_small([["a"], ["b", "c", "d"]], 2) == [["a", "b", "c", "d"]]
    two = Y.spectral_kernel(list("abcdef"), [(x, y, 1.0) for g in ("abc", "def") for x in g for y in g if x < y] + [("c", "d", 0.01)], 2, 5)
    assert len(set(two[:3])) == 1 and len(set(two[3:])) == 1 and two[0] != two[5]


def test_crossings_agree(spark):
    order, layer = [["a", "b"], ["c", "d"]], {"a": 0, "b": 0, "c": 1, "d": 1}
    edges = [("a", "d"), ("b", "c"), ("a", "c")]
    places = spark.createDataFrame([(n, k, i) for k, row in enumerate(order) for i, n in enumerate(row)], "id string, layer long, position long")
    assert Y.crossings(order, edges, layer) == 1 == Y.crossing_count(spark.createDataFrame(edges, "from_id string, to_id string"), places).first().crossings
    assert Y.crossings(Y.order_layers(layer, edges[:2], {}), edges[:2], layer) == 0


def test_reconciliation(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id string, label string, module_id string, ord long")
    old = mk([("a", "Alpha", "M", 0), ("o1", "beta thing", "M", 1), ("o2", "gamma ray burst one two", "M", 2), ("o3", "nothing", "M", 3)])
    new = mk([("a", "Other", "M", 0), ("n1", "Beta Thing", "X", 1), ("n2", "gamma ray burst one", "M", 2)])
    assert {tuple(r) for r in D.map_ids(old, new).collect()} == {("a", "a", "exact"), ("o1", "n1", "label"), ("o2", "n2", "fuzzy")}


def test_audit(spark):
    g = build(spark, "a:M b:M c:M a:M", "a>b:L1 b>b:L1 a>zz:L1")
    assert {tuple(r) for r in D.audit(g).collect()} == {("duplicate_node", "a"), ("self_loop", "e2"), ("broken_target", "e3"), ("orphan", "c")}


def test_metrics(spark):
    r = D.metrics(spark.createDataFrame([(float(i),) for i in range(1, 9)], "value double")).first()
    assert (r.n, r.p25, r.p75, r.median) == (8, 3.0, 7.0, 4.5)


def test_stream_of_edges(spark, tmp_path):
    rows = [("e1", "a", "b", 1, False), ("e1", "a", "c", 2, False), ("e2", "x", "y", 1, False), ("e2", "x", "y", 3, True)]
    schema = "id string, source string, target string, version long, deleted boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = U.maintain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = U.latest(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert [(r.id, r.target) for r in got] == [("e1", "c")]
