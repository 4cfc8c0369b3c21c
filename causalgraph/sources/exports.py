"""Writers: node-link JSON, GraphML, GEXF, CSV and TSV, adjacency matrix, view state.

Text formats are built as columns of lines, so that large graphs are written by many
tasks; the single-document forms gather them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import LEVELS
from ..functions.scalars import literal_map
from ..graph import CATEGORIES, RELATIONS, CausalGraph
from ..plans.rank import rank

NODE_FIELDS = ["id", "label", "category", "subtype", "module_id", "description", "roles", "pmid"]
EDGE_FIELDS = ["id", "source", "target", "relation", "module_id", "causal_confidence", "mechanism_description", "key_insight", "pmid", "first_author", "year", "method_type", "notes"]


def _has(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns in order, null where the table lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names], "ord", *([c for c in ("strength",) if c in df.columns]))


def escape_xml(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def wire(c: Column, debug_names: bool) -> Column:
    """An enum's name on the wire, or with its words in capitals' case."""
    if not debug_names:
        return c
    names = {x: x.capitalize() for x in CATEGORIES} | {x: x[0].upper() + x[1:] for x in RELATIONS} | {x: x for x in LEVELS}
    return F.coalesce(literal_map(names)[c], c)


def node_link(g: CausalGraph) -> DataFrame:
    """One row (value): {directed, multigraph, graph, nodes, links}."""
    n = _has(g.nodes, NODE_FIELDS)
    e = _has(g.edges, EDGE_FIELDS)
    ordered = lambda df, fields: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))), lambda s: s["x"]).alias("a"), F.count(F.lit(1)).alias("n"))
    rows = ordered(n, NODE_FIELDS).toDF("nodes", "nn").crossJoin(ordered(e, [*EDGE_FIELDS, F.col("strength").alias("weight")]).toDF("links", "ne"))
    return rows.select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.struct(F.col("nn").alias("node_count"), F.col("ne").alias("edge_count")).alias("graph"), "nodes", "links")).alias("value"))


def _document(head: str, parts: list[DataFrame], foot: str) -> DataFrame:
    """(part, ord, value): lines of a document in order; each part has ord and value."""
    spark = parts[0].sparkSession
    edge = lambda k, v: spark.createDataFrame([(k, 0, v)], "part int, ord long, value string")
    out = edge(0, head)
    for k, p in enumerate(parts, 1):
        out = out.unionByName(p.select(F.lit(k).alias("part"), F.col("ord").cast("long").alias("ord"), "value"))
    return out.unionByName(edge(len(parts) + 1, foot))


def as_text(lines: DataFrame) -> DataFrame:
    """One row (value) with the whole document."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "value"))), lambda s: s["value"]), "\n").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """One file in order."""
    lines.orderBy("part", "ord").coalesce(1).select("value").write.mode("overwrite").text(path)


GRAPHML_KEYS = [("label", "node"), ("category", "node"), ("subtype", "node"), ("moduleId", "node"), ("roles", "node"), ("relation", "edge"), ("causalConfidence", "edge"), ("pmid", "edge"), ("weight", "edge")]


def graphml(g: CausalGraph, debug_names: bool = False) -> DataFrame:
    """Lines of a GraphML document; with wire names (the default) it can be read again."""
    data = lambda k, v: F.concat(F.lit(f'<data key="{k}">'), escape_xml(v), F.lit("</data>"))
    n = _has(g.nodes, NODE_FIELDS)
    nodes = n.select("ord", F.concat(F.lit('<node id="'), escape_xml(F.col("id")), F.lit('">'), data("label", F.col("label")), data("category", wire(F.col("category"), debug_names)), data("subtype", F.col("subtype")), data("moduleId", F.col("module_id")), data("roles", F.array_join("roles", ",")), F.lit("</node>")).alias("value"))
    e = _has(g.edges, EDGE_FIELDS)
    edges = e.select("ord", F.concat(F.lit('<edge id="'), escape_xml(F.col("id")), F.lit('" source="'), escape_xml(F.col("source")), F.lit('" target="'), escape_xml(F.col("target")), F.lit('">'), data("relation", wire(F.col("relation"), debug_names)), data("causalConfidence", F.col("causal_confidence")), F.when(F.col("pmid").isNotNull(), data("pmid", F.col("pmid"))).otherwise(""), data("weight", F.col("strength")), F.lit("</edge>")).alias("value"))
    keys = "".join(f'<key id="{k}" for="{d}" attr.name="{k}" attr.type="{"double" if k == "weight" else "string"}"/>' for k, d in GRAPHML_KEYS)
    return _document(f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}\n<graph id="G" edgedefault="directed">', [nodes, edges], "</graph>\n</graphml>")


def gexf(g: CausalGraph, debug_names: bool = False) -> DataFrame:
    """Lines of a GEXF 1.3 document; attribute values by place."""
    vals = lambda *vs: F.concat(F.lit("<attvalues>"), *[F.concat(F.lit(f'<attvalue for="{i}" value="'), escape_xml(v), F.lit('"/>')) for i, v in enumerate(vs)], F.lit("</attvalues>"))
    n, e = _has(g.nodes, NODE_FIELDS), _has(g.edges, EDGE_FIELDS)
    nodes = n.select("ord", F.concat(F.lit('<node id="'), escape_xml(F.col("id")), F.lit('" label="'), escape_xml(F.col("label")), F.lit('">'), vals(wire(F.col("category"), debug_names), F.col("subtype"), F.col("module_id")), F.lit("</node>")).alias("value"))
    edges = e.select("ord", F.concat(F.lit('<edge id="'), escape_xml(F.col("id")), F.lit('" source="'), escape_xml(F.col("source")), F.lit('" target="'), escape_xml(F.col("target")), F.lit('" weight="'), F.col("strength"), F.lit('">'), vals(wire(F.col("relation"), debug_names), F.col("causal_confidence")), F.lit("</edge>")).alias("value"))
    attrs = lambda kind, *names: f'<attributes class="{kind}">' + "".join(f'<attribute id="{i}" title="{x}" type="string"/>' for i, x in enumerate(names)) + "</attributes>"
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph mode="static" defaultedgetype="directed">' + attrs("node", "category", "subtype", "moduleId") + attrs("edge", "relation", "causalConfidence")
    mid_a = nodes.sparkSession.createDataFrame([(0, "<nodes>")], "ord long, value string")
    mid_b = nodes.sparkSession.createDataFrame([(0, "</nodes><edges>")], "ord long, value string")
    return _document(head, [mid_a, nodes, mid_b, edges], "</edges></graph></gexf>")


def quote_csv(c: Column, sep: str = ",") -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.contains(sep) | s.contains('"') | s.contains("\n"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def _delimited(df: DataFrame, names: list[str], sep: str) -> DataFrame:
    camel = lambda c: c.split("_")[0] + "".join(w.capitalize() for w in c.split("_")[1:])
    rows = df.select("ord", F.concat_ws(sep, *[quote_csv(F.array_join(c, ";") if c == "roles" else F.col(c), sep) for c in names]).alias("value"))
    return _document(sep.join(map(camel, names)), [rows], "").where("part < 2")


def csv_nodes(g: CausalGraph, sep: str = ",") -> DataFrame:
    """Lines: a header and the nodes, fields quoted only where needed; sep="\\t" gives TSV."""
    return _delimited(_has(g.nodes, NODE_FIELDS), NODE_FIELDS, sep)


def csv_edges(g: CausalGraph, sep: str = ",") -> DataFrame:
    return _delimited(_has(g.edges, EDGE_FIELDS), EDGE_FIELDS, sep)


SYMBOLS = {"increases": "+", "directlyIncreases": "++", "decreases": "-", "directlyDecreases": "--", "inhibits": "-|", "regulates": "~", "modulates": "~"}


def adjacency_cells(g: CausalGraph) -> DataFrame:
    """(source, target, cell): relation symbol and level of the latest edge of each pair."""
    sym = F.coalesce(literal_map(SYMBOLS)[F.col("relation")], F.lit("*"))
    return g.edges_rep.select("source", "target", F.concat(sym, "causal_confidence").alias("cell"))


def adjacency_matrix(g: CausalGraph, module_order: list[str]) -> DataFrame:
    """One row a node, one column a node, by (module order, label), with a dash on the diagonal."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in module_order]), F.col("module_id")), F.lit(0)), F.lit(99))
    order = [r.id for r in g.nodes.select("id", place.alias("p"), "label").orderBy("p", "label").collect()]  # a column each
    cells = adjacency_cells(g).unionByName(g.nodes.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("—").alias("cell")))
    wide = cells.groupBy("source").pivot("target", order).agg(F.max("cell"))
    return wide.withColumn("__p", F.array_position(F.array(*[F.lit(i) for i in order]), F.col("source"))).orderBy("__p").drop("__p").na.fill("")


def view_state_json(state: DataFrame) -> DataFrame:
    """(value) of saved views(evidenceFilter, hiddenModules, pinnedNodes, selectedNode), version 1.1."""
    return state.select(F.to_json(F.struct(F.lit("1.1").alias("version"), "evidenceFilter", "hiddenModules", "pinnedNodes", "selectedNode")).alias("value"))


def report(rows: DataFrame, name: str) -> DataFrame:
    """One row (value): {name, count, rows} with the rows in order of their text."""
    return rows.select(F.struct(*rows.columns).alias("x")).agg(F.to_json(F.struct(F.lit(name).alias("name"), F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("x")).alias("rows"))).alias("value"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """With ord from an explicit sort."""
    return rank(df, list(order), "ord")
