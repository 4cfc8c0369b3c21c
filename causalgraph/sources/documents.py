"""Readers: graph JSON, curated frameworks, simple JSON, GraphML, SVG positions, synthetic graphs, literature answers, view states."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CausalGraph

VARIANT = "struct<id:string,nodeId:string,label:string,effectDirection:string,effectMagnitude:double,effectDescription:string,frequency:double,color:string,isDefault:boolean,pmid:string,oddsRatio:double,ciLow:double,ciHigh:double,population:string>"
NODE = f"struct<id:string,label:string,category:string,subtype:string,moduleId:string,description:string,mechanism:string,roles:array<string>,pmid:string,notes:string,variants:array<{VARIANT}>,defaultVariant:string,x:double,y:double>"
EVIDENCE = "struct<pmid:string,firstAuthor:string,year:int,methodType:string>"
EDGE = f"struct<id:string,source:string,target:string,relation:string,moduleId:string,causalConfidence:string,mechanismDescription:string,keyInsight:string,pmid:string,firstAuthor:string,year:int,methodType:string,notes:string,evidence:{EVIDENCE}>"
MODULE = "struct<id:string,name:string,shortName:string,description:string,color:string>"
DOCUMENT = f"nodes array<{NODE}>, edges array<{EDGE}>, modules array<{MODULE}>, confidenceWeights map<string,double>"


def snake(name: str) -> str:
    return re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name)


def _flat(df: DataFrame, column: str) -> DataFrame:
    """One row for each element, snake-case columns, ord from its place."""
    rows = df.select(F.posexplode(column).alias("ord", "x")).select("x.*", F.col("ord").cast("long").alias("ord"))
    return rows.toDF(*[snake(c) for c in rows.columns])


def from_json(spark: SparkSession, path: str, scheme=None) -> CausalGraph:
    """A graph document {nodes, edges, modules, confidenceWeights}; raises on bad enums and dangling ends."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    weights = doc.select("confidenceWeights").first()
    nodes = _flat(doc, "nodes").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    edges = flatten_evidence(_flat(doc, "edges"))
    return CausalGraph(nodes, edges, _flat(doc, "modules"), dict(weights[0]) if weights and weights[0] else None, scheme, check=True)


def flatten_evidence(edges: DataFrame) -> DataFrame:
    """Edges of a curated framework: pmid and method from the edge, else its evidence; author and year from the evidence where it has them; level L7 by default."""
    if "evidence" not in edges.columns:
        return edges
    e = lambda c: F.col(f"evidence.{c}")
    return edges.withColumns({
        "pmid": F.coalesce("pmid", e("pmid")), "method_type": F.coalesce("method_type", e("methodType")),
        "first_author": F.coalesce(e("firstAuthor"), "first_author"), "year": F.coalesce(e("year"), "year"),
        "causal_confidence": F.coalesce("causal_confidence", F.lit("L7")),
    }).drop("evidence")


TIPPING = "struct<biomarker:string,threshold:string,timescale:string,interpretation:string,interventionWindow:string>"
LOOPS = f"feedbackLoops array<struct<id:string,name:string,type:string,description:string,edgeIds:array<string>,clinicalImplication:string,interventionPoints:array<string>,moduleIds:array<string>,tippingPoint:{TIPPING},loopTimescale:string>>"


def from_loops(doc: DataFrame) -> DataFrame:
    """Curated loops of rows (schema LOOPS), one a row in snake case; tipping points as columns, null where a loop has none, lists empty where they lack."""
    loops = _flat(doc, "feedbackLoops")
    none = F.array().cast("array<string>")
    loops = loops.withColumns({c: F.coalesce(c, none) for c in ("edge_ids", "intervention_points", "module_ids")})
    tips = {f"tipping_{c}": F.col(f"tipping_point.{c}") for c in ("biomarker", "threshold", "timescale", "interpretation")}
    return loops.withColumns({**tips, "intervention_window": F.col("tipping_point.interventionWindow")}).drop("tipping_point")


SIMPLE = "nodes array<struct<id:string,label:string,name:string,category:string,subtype:string,moduleId:string,description:string>>, edges array<struct<id:string,source:string,target:string,relation:string,label:string,causalConfidence:string,moduleId:string>>, modules array<struct<id:string,name:string,color:string>>"


def from_simple(doc: DataFrame) -> CausalGraph:
    """Simple JSON rows (schema SIMPLE), with defaults: STOCK, module `default`, association, L7, edge id e_{source}_{target}_{place}."""
    nodes = _flat(doc, "nodes")
    nodes = nodes.select("id", F.coalesce("label", "name", "id").alias("label"), F.coalesce("category", F.lit("STOCK")).alias("category"), F.coalesce("subtype", F.lit("")).alias("subtype"), F.coalesce("module_id", F.lit("default")).alias("module_id"), F.coalesce("description", F.lit("")).alias("description"), F.array().cast("array<string>").alias("roles"), "ord")
    edges = _flat(doc, "edges")
    none = F.lit(None).cast("string")
    edges = edges.select(F.coalesce("id", F.concat_ws("_", F.lit("e"), "source", "target", "ord")).alias("id"), "source", "target", F.coalesce("relation", F.lit("association")).alias("relation"), F.coalesce("module_id", F.lit("default")).alias("module_id"), F.coalesce("causal_confidence", F.lit("L7")).alias("causal_confidence"), F.col("label").alias("key_insight"), none.alias("pmid"), none.alias("method_type"), "ord")
    given = _flat(doc, "modules").select("id", "name", F.substring("name", 1, 4).alias("short_name"), "color")
    default = doc.sparkSession.createDataFrame([("default", "Default", "Defa", "#888888")], "id string, name string, short_name string, color string")
    modules = given.unionByName(default.join(given.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))
    return CausalGraph(nodes, edges, modules)


# ---- XML


def from_graphml(spark: SparkSession, path: str) -> CausalGraph:
    """GraphML: data by key names, labels from label, Label or id, roles split at commas; numbers that don't parse count 0 (positions) or 1 (weights)."""
    text = spark.read.text(path, wholetext=True)
    return parse_graphml(text)


def parse_graphml(text: DataFrame) -> CausalGraph:
    """As from_graphml, from rows (value) of whole documents; each is parsed in its task."""
    schema = "kind string, id string, source string, target string, data map<string,string>, ord long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        local = lambda el: el.tag.rsplit("}", 1)[-1]
        for part in parts:
            rows = []
            for value in part["value"]:
                root = ET.fromstring(value)
                keys = {k.get("id"): k.get("attr.name", k.get("id")) for k in root if local(k) == "key"}
                graph = next((x for x in root if local(x) == "graph"), None)
                for i, el in enumerate(graph if graph is not None else ()):
                    if local(el) in ("node", "edge"):
                        data = {keys.get(d.get("key"), d.get("key")): d.text or "" for d in el if local(d) == "data"}
                        rows.append((local(el), el.get("id"), el.get("source"), el.get("target"), data, i))
            yield pd.DataFrame(rows, columns=["kind", "id", "source", "target", "data", "ord"])

    rows = text.select("value").mapInPandas(run, schema)
    d = lambda *names: F.coalesce(*[F.col("data")[n] for n in names])
    roles = F.when(F.coalesce(d("roles"), F.lit("")) != "", F.transform(F.split(d("roles"), ","), lambda r: F.trim(r))).otherwise(F.array().cast("array<string>"))
    nodes = rows.where("kind = 'node'").select("id", F.coalesce(d("label", "Label"), "id").alias("label"), F.coalesce(d("category"), F.lit("STOCK")).alias("category"), F.coalesce(d("subtype"), F.lit("")).alias("subtype"), F.coalesce(d("moduleId", "module_id"), F.lit("default")).alias("module_id"), F.coalesce(d("description"), F.lit("")).alias("description"), roles.alias("roles"), F.coalesce(d("x").try_cast("double"), F.lit(0.0)).alias("x"), F.coalesce(d("y").try_cast("double"), F.lit(0.0)).alias("y"), "ord")
    edges = rows.where("kind = 'edge'").select(F.coalesce("id", F.concat_ws("_", F.lit("e"), "source", "target", "ord")).alias("id"), "source", "target", F.coalesce(d("relation"), F.lit("association")).alias("relation"), F.coalesce(d("moduleId", "module_id"), F.lit("default")).alias("module_id"), F.coalesce(d("causalConfidence", "confidence"), F.lit("L7")).alias("causal_confidence"), d("label").alias("key_insight"), d("pmid").alias("pmid"), d("methodType").alias("method_type"), F.coalesce(d("weight").try_cast("double"), F.lit(1.0)).alias("weight"), "ord")
    return CausalGraph(nodes, edges)


def svg_positions(text: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(id, x, y) of the elements with an id outside of definitions, from rows (value) of whole SVG documents.

    A matrix's or translate's offset, else x, cx or y, cy with half of width and height;
    elements at (0, 0) are left out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        skip = {"defs", "clipPath", "mask", "pattern", "marker", "symbol", "linearGradient", "radialGradient", "style", "metadata"}

        def walk(el):
            if el.tag.rsplit("}", 1)[-1] in skip:
                return
            yield el
            for child in el:
                yield from walk(child)

        def number(el, *names: str) -> float:
            for n in names:
                try:
                    return float(re.match(r"-?[0-9.]+", el.get(n, ""))[0])
                except (TypeError, ValueError):
                    continue
            return 0.0

        def place(el) -> tuple[float, float]:
            t = el.get("transform", "")
            if m := re.search(r"matrix\(([^)]*)\)", t):
                v = [float(x) for x in re.split(r"[\s,]+", m[1].strip())]
                return v[4], v[5]
            if m := re.search(r"translate\(([^)]*)\)", t):
                v = [float(x) for x in re.split(r"[\s,]+", m[1].strip())]
                return v[0], v[1] if len(v) > 1 else 0.0
            return number(el, "x", "cx") + number(el, "width") / 2, number(el, "y", "cy") + number(el, "height") / 2

        for part in parts:
            rows = [(el.get("id"), *place(el)) for v in part["value"] for el in walk(ET.fromstring(v)) if el.get("id") and (ids is None or el.get("id") in ids)]
            yield pd.DataFrame([r for r in rows if (r[1], r[2]) != (0.0, 0.0)], columns=["id", "x", "y"])

    return text.select("value").mapInPandas(run, "id string, x double, y double")


# ---- generated and recorded


class XorShift:
    """32-bit xorshift with signed shifts, as floats in [0, 1)."""

    def __init__(self, seed: int = 42):
        self.state = seed

    def __call__(self) -> float:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFF
        signed = x - (1 << 32) if x & 0x80000000 else x
        x = (x ^ (signed >> 17)) & 0xFFFFFFFF
        x = (x ^ (x << 5)) & 0xFFFFFFFF
        self.state = x
        return x / 4294967296


def synthetic(spark: SparkSession, n: int, density: float = 1.8, modules: int = 6, seed: int = 42) -> CausalGraph:
    """A seeded graph of n nodes and about density n edges: a chain with look-back, hubs, edges across modules; no self-loops, no parallel edges.

    The generator is sequential; it makes test graphs, on the driver.
    """
    draw = XorShift(seed)
    pick = lambda k: int(draw() * k)
    cats = ("STOCK", "STATE", "PROCESS", "BOUNDARY")
    block = max(1, math.ceil(n / modules))
    nodes = [(f"node_{i}", f"Node {i}", cats[pick(4)], "Generic", f"M{i // block + 1:02d}", i) for i in range(n)]
    wanted, seen, edges = round(density * n), set(), []
    relations = ("increases", "decreases", "regulates", "modulates", "inhibits")

    def add(a: int, b: int) -> None:
        if a != b and (a, b) not in seen and len(edges) < wanted:
            seen.add((a, b))
            edges.append((f"edge_{len(edges)}", f"node_{a}", f"node_{b}", relations[pick(5)], nodes[a][4], f"L{1 + pick(7)}", len(edges)))

    for i in range(1, n):
        add(max(0, i - 1 - pick(min(20, i))), i)
    hubs = [pick(n) for _ in range(max(3, n // 20))] if n else []
    for h in hubs:
        for _ in range(3):
            add(h, pick(n))
    for _ in range(wanted // 5):
        a, b = pick(n), pick(n)
        if nodes[a][4] != nodes[b][4]:
            add(min(a, b), max(a, b))
    for _ in range(20 * wanted):
        if len(edges) >= wanted:
            break
        a, b = pick(n), pick(n)
        add(min(a, b), max(a, b))
    nd = spark.createDataFrame(nodes, "id string, label string, category string, subtype string, module_id string, ord long").withColumns({"roles": F.array().cast("array<string>"), "description": F.lit("")})
    ed = spark.createDataFrame(edges, "id string, source string, target string, relation string, module_id string, causal_confidence string, ord long").withColumns({"pmid": F.lit(None).cast("string"), "method_type": F.lit(None).cast("string")})
    return CausalGraph(nd, ed)


def source_records(text: DataFrame) -> DataFrame:
    """(ord, record map<string,string>) of the object literals with an id in rows (value) of source text; braces are matched, strings may span lines."""

    def records(s: str) -> Iterator[dict]:
        quote, bodies, i = "", [[]], 0  # the text of each open brace, without what lies in inner braces
        while i < len(s):
            c = s[i]
            if quote:
                if c == "\\":
                    bodies[-1].append(c)
                    i += 1
                    c = s[i : i + 1]
                elif c == quote:
                    quote = ""
            elif c in "'\"`":
                quote = c
            elif c == "{":
                bodies.append([])
                i += 1
                continue
            elif c == "}":
                body = "".join(bodies.pop()) if len(bodies) > 1 else ""
                pairs = re.findall(r"(\w+)\s*:\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|`((?:[^`\\]|\\.)*)`|([\w.+-]+))", body)
                rec = {k: re.sub(r"\\(.)", r"\1", next((x for x in v if x), "")) for k, *v in pairs}
                if "id" in rec:
                    yield rec
                i += 1
                continue
            bodies[-1].append(c)
            i += 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, r) for v in part["value"] for i, r in enumerate(records(v))]
            yield pd.DataFrame(rows, columns=["ord", "record"])

    return text.select("value").mapInPandas(run, "ord long, record map<string,string>")


def abstracts(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """(pmid, abstract) for asked(pmid), null where the responses (value: XML with many articles) have none."""
    article = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<PubmedArticle>(.*?)</PubmedArticle>"), F.lit(1))).alias("a")
    texts = F.regexp_extract_all("a", F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1))
    plain = F.array_join(F.transform(texts, lambda t: F.trim(F.regexp_replace(t, "<[^>]+>", ""))), " ")
    got = responses.select(article).select(F.regexp_extract("a", r"<PMID[^>]*>([0-9]+)</PMID>", 1).alias("p"), plain.alias("abstract")).where("abstract <> ''")
    return asked.join(got, F.col("pmid") == F.col("p"), "left").select("pmid", "abstract")


def view_state(text: Column) -> Column:
    """A struct of the well-typed fields of a saved view; null without a version. Unknown evidence filters become null."""
    raw = F.from_json(text, "version string, evidenceFilter string, hiddenModules array<string>, pinnedNodes array<string>, selectedNode string")
    level = F.when(raw["evidenceFilter"].isin("all", "moderate", "strong"), raw["evidenceFilter"])
    return F.when(raw["version"].isNotNull(), raw.withField("evidenceFilter", level))


def coordinates(spark: SparkSession, table: dict[str, tuple[float, float]]) -> DataFrame:
    """(id, x, y) of a fixed table of places."""
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in table.items()], "id string, x double, y double")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, n) of the links in pages(page_id, html)."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")
    return pages.select("page_id", href).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))
