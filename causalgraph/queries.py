"""Queries over the driver's tables, one or more for each operator, and the SQL that states their results.

Most run on the trade graph (plans.projections); keys are operator id and name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import confidence as K
from .functions import scalars as S
from .operators import basic as B
from .operators import catalog as T
from .operators import centrality as A
from .operators import curation as D
from .operators import layout as Y
from .operators import structure as L
from .operators import traversal as P
from .plans import projections as G
from .plans.lineage import checkpoint
from .sources import documents as SRC
from .sources import exports as X
from .streaming import updates as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Joined by several paths at every scale of the tables.
START, END = "N18", "N10"
TARGETS = ["N03", "N08", "N99"]


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def on_trade(name: str, sql: str | None = None, stored: bool = False):
    """A query of the trade graph; its SQL may use the tables `nodes` and `edges`."""
    full = None if sql is None else f"WITH RECURSIVE {G.TRADE_CTE}{sql if sql.startswith(',') else chr(10) + sql}"

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            g = G.trade(spark, sf_dir)
            return fn(g.stored() if stored else g)

        register(name, full)(run)
        return fn

    return keep


BIG = lambda c: F.col(c).cast("bigint").alias(c)

# ---- the slice from end to end

register("slice_trade_degree", f"""WITH {G.TRADE_CTE}, strong AS (SELECT * FROM edges WHERE conf_rank <= 3),
x AS (SELECT source AS n, 0 AS i, 1 AS o FROM strong UNION ALL SELECT target, 1, 0 FROM strong UNION ALL SELECT id, 0, 0 FROM nodes)
SELECT n AS node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS total,
sum(i + o) / (SELECT count(*) - 1 FROM nodes) AS normalized FROM x GROUP BY n""")(
    lambda spark, sf: A.degree_of((g := G.trade(spark, sf)).nodes, g.edges.where("conf_rank <= 3").select(F.col("source").alias("src"), F.col("target").alias("dst"))).orderBy(F.col("total").desc(), "node_id")
)

# ---- projection and lookup

on_trade("r01_stats", "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")(B.stats)
on_trade("r02_node", f"SELECT id, label, module_id FROM nodes WHERE id = '{START}'")(lambda g: B.node(g, START).select("id", "label", "module_id"))
on_trade("r03_successors", f"SELECT target AS id, id AS edge_id FROM edges WHERE source = '{START}'")(lambda g: B.successors(g, START))
on_trade("r03_predecessors", f"SELECT source AS id, id AS edge_id FROM edges WHERE target = '{END}'")(lambda g: B.predecessors(g, END))
register("r04_representative_edges", f"WITH f AS ({G.EVENT_EDGES}), d AS (SELECT source, target, n, 'x' || CAST(n AS VARCHAR) AS id FROM f UNION ALL SELECT source, target, n + 1, 'y' || CAST(n AS VARCHAR) FROM f WHERE n % 2 = 0) SELECT source, target, max_by(id, n) AS id FROM d GROUP BY source, target")(
    lambda spark, sf: (lambda f: G.CausalGraph(f, f.select("source", "target", F.col("n").alias("ord"), F.concat(F.lit("x"), F.col("n").cast("string")).alias("id"), F.lit("regulates").alias("relation"), F.lit("L1").alias("causal_confidence"))
        .unionByName(f.where("n % 2 = 0").select("source", "target", (F.col("n") + 1).alias("ord"), F.concat(F.lit("y"), F.col("n").cast("string")).alias("id"), F.lit("regulates").alias("relation"), F.lit("L1").alias("causal_confidence")))).edges_rep.select("source", "target", "id"))(G.event_flow(spark, sf))
)
on_trade("r05_edges", "SELECT id, source, target, conf_rank, strength, distance, is_inhibitory FROM edges")(lambda g: g.edges.select("id", "source", "target", "conf_rank", "strength", "distance", "is_inhibitory"))
on_trade("r06_edges_by_module", "SELECT id, source, target FROM edges WHERE module_id = 'R2'")(lambda g: B.edges_by(g, module="R2").select("id", "source", "target"))
on_trade("r07_downstream_records", f"SELECT n.id, n.label, n.category FROM edges e JOIN nodes n ON e.target = n.id WHERE e.source = '{START}'")(lambda g: B.neighbours(g, START, upstream=False).select("id", "label", "category"))
on_trade("r08_adjacency", "SELECT n.id, coalesce(string_agg(e.target, ',' ORDER BY e.target), '') AS targets FROM nodes n LEFT JOIN edges e ON n.id = e.source GROUP BY n.id")(lambda g: B.adjacency(g).select("id", F.array_join("targets", ",").alias("targets")))
on_trade("r09_inspector", "SELECT n.id, n.label, r_name AS module_name, (SELECT count(*) FROM edges WHERE target = n.id) AS n_in, (SELECT count(*) FROM edges WHERE source = n.id) AS n_out FROM nodes n LEFT JOIN region ON n.module_id = 'R' || CAST(r_regionkey AS VARCHAR)")(B.inspector)
on_trade("r10_module_counts", "SELECT module_id, count(*) AS n_nodes FROM nodes GROUP BY 1")(B.module_counts)
CATS = {"R0": "upstream", "R1": "upstream", "R2": "core", "R3": "core"}
on_trade("r11_module_categories", "SELECT CASE WHEN module_id IN ('R0', 'R1') THEN 'upstream' WHEN module_id IN ('R2', 'R3') THEN 'core' ELSE 'boundary' END AS category, string_agg(DISTINCT module_id, ',' ORDER BY module_id) AS modules FROM nodes GROUP BY 1")(
    lambda g: B.module_categories(g, CATS, ["upstream", "core", "boundary"]).select("category", F.array_join("modules", ",").alias("modules"))
)

# ---- filters

on_trade("f01_by_modules", "SELECT id FROM nodes WHERE module_id IN ('R1', 'R3')")(lambda g: B.filter_by_modules(g, ["R1", "R3"]))
on_trade("f02_by_confidence", "SELECT id FROM edges WHERE conf_rank <= 3")(lambda g: B.filter_edges_by_confidence(g, "L3"))
on_trade("f03_modules_for_nodes", "SELECT DISTINCT module_id FROM nodes WHERE id IN ('N03', 'N08', 'N99')")(lambda g: B.modules_for_nodes(g, g.nodes.sparkSession.createDataFrame([(t,) for t in TARGETS], "id string")))
on_trade("f04_subgraph", "SELECT id, source, target, strength FROM edges WHERE source IN (SELECT id FROM nodes WHERE ord % 2 = 0) AND target IN (SELECT id FROM nodes WHERE ord % 2 = 0)")(
    lambda g: g.subgraph(g.nodes.where("ord % 2 = 0").select("id")).edges.select("id", "source", "target", "strength")
)
on_trade("f05_cutoffs", "SELECT id, conf_rank <= 3 AS strong, conf_rank <= 5 AS moderate, true AS all_levels FROM edges")(
    lambda g: g.edges.select("id", *[B.passes_cutoff(F.col("causal_confidence"), c).alias(n) for c, n in (("strong", "strong"), ("moderate", "moderate"), ("all", "all_levels"))])
)
VIEW = ", v AS (SELECT * FROM nodes WHERE module_id IN ('R0', 'R2', 'R3')), ve AS (SELECT * FROM edges WHERE conf_rank <= 5 AND source IN (SELECT id FROM v) AND target IN (SELECT id FROM v))"
on_trade("f06_view_filter", VIEW + " SELECT id FROM v WHERE id IN (SELECT source FROM ve UNION SELECT target FROM ve)")(lambda g: B.view_filter(g, ["R0", "R2", "R3"], "moderate", True)[0].select("id"))
on_trade("f07_strip_orphans", "SELECT id FROM nodes WHERE id IN (SELECT source FROM edges WHERE conf_rank = 1 UNION SELECT target FROM edges WHERE conf_rank = 1)")(lambda g: B.strip_orphans(g.nodes, g.edges.where("conf_rank = 1")).select("id"))
on_trade("f08_high_confidence", "SELECT id FROM edges WHERE conf_rank <= 3")(lambda g: B.high_confidence(g).select("id"))
on_trade("f08_cross_module", "SELECT e.id, a.module_id AS source_module, b.module_id AS target_module FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE a.module_id <> b.module_id")(lambda g: B.cross_module(g).select("id", "source_module", "target_module"))
on_trade("f08_therapeutic_targets", "SELECT id FROM nodes WHERE role = 'THERAPEUTIC_TARGET'")(lambda g: B.with_role(g, "THERAPEUTIC_TARGET").select("id"))
on_trade("f08_hubs", "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) AS x GROUP BY id HAVING count(*) >= 5")(B.hubs)
on_trade("f09_search", "SELECT id, label FROM nodes WHERE contains(lower(label), 'nation_1') OR contains(lower(id), 'nation_1') ORDER BY ord LIMIT 20")(lambda g: B.search(g, "NATION_1"))
on_trade("f10_focus", f"SELECT DISTINCT n.module_id, CASE WHEN n.module_id = (SELECT module_id FROM nodes WHERE id = '{START}') OR n.module_id IN (SELECT module_id FROM nodes WHERE id IN (SELECT target FROM edges WHERE source = '{START}' UNION SELECT source FROM edges WHERE target = '{START}')) THEN 'on' ELSE 'off' END AS state FROM nodes n")(lambda g: B.focus(g, START))
on_trade("f11_toggle", "SELECT DISTINCT module_id, CASE WHEN module_id = 'R1' THEN 'partial' ELSE 'on' END AS state FROM nodes")(lambda g: B.toggle(B.set_all(g, "on"), "R1"))
on_trade("f12_back_edges", "SELECT e.id FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE a.ord % 5 >= b.ord % 5")(lambda g: B.back_edges(g.edges, g.nodes.select("id", (F.col("ord") % 5).alias("layer"))).select("id"))
on_trade("f13_visible", "SELECT id FROM nodes WHERE id = 'N02' OR (module_id IN ('R1', 'R2') AND category <> 'BOUNDARY')")(
    lambda g: B.visible(g, B.set_all(g, "on").where("module_id in ('R1', 'R2')"), ["N02"], True)
)
PSEUDO = """, e AS (SELECT x.id, x.source, x.target, a.module_id AS sm, b.module_id AS tm FROM edges x JOIN nodes a ON x.source = a.id JOIN nodes b ON x.target = b.id),
i AS (SELECT tm AS m, sm AS v FROM e WHERE sm IN ('R0', 'R1') AND tm NOT IN ('R0', 'R1')), o AS (SELECT sm AS m, tm AS v FROM e WHERE sm NOT IN ('R0', 'R1') AND tm IN ('R0', 'R1')),
b AS (SELECT DISTINCT i.m FROM i JOIN o ON i.m = o.m AND i.v <> o.v)
SELECT b.m AS module_id, (SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM i WHERE i.m = b.m) AS sources, (SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM o WHERE o.m = b.m) AS targets FROM b"""
on_trade("f14_pseudo_nodes", PSEUDO)(lambda g: B.pseudo_nodes(g, ["R0", "R1"])[0].select("module_id", F.array_join("sources", ",").alias("sources"), F.array_join("targets", ",").alias("targets")))
on_trade("f15_boundaries", "SELECT id, CASE WHEN id NOT IN (SELECT target FROM edges) THEN 'input' WHEN id NOT IN (SELECT source FROM edges) THEN 'output' ELSE 'inner' END AS side FROM nodes WHERE category = 'BOUNDARY'")(B.boundaries)

# ---- confidence and scalar semantics

CUSTOM = {"L1": 0.9, "L7": 0.1}
on_trade("k01_k02_weights", "SELECT id, CASE causal_confidence WHEN 'L1' THEN 0.9::DOUBLE WHEN 'L7' THEN 0.1::DOUBLE ELSE strength END AS strength, 1 / CASE causal_confidence WHEN 'L1' THEN 0.9::DOUBLE WHEN 'L7' THEN 0.1::DOUBLE ELSE strength END AS distance FROM edges")(
    lambda g: g.edges.select("id", K.strength(F.col("causal_confidence"), CUSTOM).alias("strength"), K.distance(F.col("causal_confidence"), CUSTOM).alias("distance"))
)
on_trade("k03_inhibitory", "SELECT relation, count(*) AS edges, bool_or(relation IN ('decreases', 'inhibits')) AS inhibitory FROM edges GROUP BY relation")(lambda g: g.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.bool_or(K.is_inhibitory(F.col("relation"))).alias("inhibitory")))
STRICT = K.Scheme("strict", [K.Rule("L2", ("knockout",), requires_pmid=True), K.Rule("L4", ("knockout",)), K.Rule("L3", ("rct",), min_existing="L3"), K.Rule("L5", (), requires_pmid=False)], "L6")
on_trade("k04_classify", "SELECT id, CASE WHEN lower(coalesce(method_type, '')) = 'knockout' AND pmid IS NOT NULL THEN 'L2' WHEN lower(coalesce(method_type, '')) = 'knockout' THEN 'L4' WHEN lower(coalesce(method_type, '')) = 'rct' AND conf_rank <= 3 THEN 'L3' WHEN pmid IS NULL THEN 'L5' ELSE 'L6' END AS level FROM edges")(
    lambda g: g.edges.select("id", STRICT.classify(F.col("method_type"), F.col("pmid"), F.col("causal_confidence")).alias("level"))
)
_METHODS = "WHEN 'rct' THEN 'L1' WHEN 'knockout' THEN 'L3' WHEN 'gwas' THEN 'L3' WHEN 'in_vitro' THEN 'L5' WHEN 'cohort' THEN 'L6'"
on_trade("k05_default_scheme", f"SELECT id, CASE lower(method_type) {_METHODS} ELSE 'L7' END AS level FROM edges")(lambda g: K.weigh(g.edges, scheme=K.ENGINE_DEFAULT).select("id", F.col("causal_confidence").alias("level")))
on_trade("k06_effective_level", f"SELECT id, coalesce(CASE WHEN conf_rank <= 2 THEN causal_confidence END, CASE lower(coalesce(method_type, '')) {_METHODS} WHEN 'review' THEN 'L7' END, 'L7') AS level FROM edges")(
    lambda g: g.edges.select("id", K.UI_DEFAULT.effective(F.col("method_type"), F.lit(None).cast("string"), F.when(F.col("conf_rank") <= 2, F.col("causal_confidence")).otherwise("")).alias("level"))
)
on_trade("k07_method", "SELECT id, CASE lower(method_type) WHEN 'rct' THEN 'rct' WHEN 'knockout' THEN 'knockout' WHEN 'gwas' THEN 'gwas' WHEN 'in_vitro' THEN 'in_vitro' WHEN 'cohort' THEN 'cohort' WHEN 'review' THEN 'cohort' END AS method FROM edges")(
    lambda g: g.edges.select("id", S.normalize_method(F.when(F.lower("method_type") == "review", "expert_opinion; cohort").otherwise(F.col("method_type"))).alias("method"))
)
on_trade("k08_relation", "SELECT id, CASE WHEN conf_rank = 1 THEN 'regulates' WHEN conf_rank = 2 THEN 'directlyIncreases' ELSE relation END AS relation, CASE WHEN conf_rank = 1 THEN 'association' WHEN conf_rank = 2 THEN 'produces' ELSE relation END AS legacy FROM edges")(
    lambda g: g.edges.select("id", S.normalize_relation(F.when(F.col("conf_rank") == 1, "odd").when(F.col("conf_rank") == 2, "directly_increases").otherwise(F.col("relation"))).alias("relation"), S.legacy_relation(F.when(F.col("conf_rank") == 1, "positiveCorrelation").when(F.col("conf_rank") == 2, "productof").otherwise(F.col("relation"))).alias("legacy"))
)


@on_trade("k09_edge_type", """SELECT e.id, CASE WHEN e.conf_rank = 7 THEN 'FLOW' WHEN e.conf_rank = 6 AND b.category = 'STATE' THEN 'MODULATION' WHEN a.role = 'REGULATOR' THEN 'MODULATION' ELSE 'INFLUENCE' END AS edge_type
FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id""")
def _edge_type(g):
    a, b = g.nodes.select(F.col("id").alias("source"), F.col("roles").alias("ra"), F.col("subtype").alias("sa")), g.nodes.select(F.col("id").alias("target"), F.col("category").alias("cb"))
    rel = F.when(F.col("conf_rank") == 7, "substrateof").when(F.col("conf_rank") == 6, "directlyIncreases").otherwise(F.col("relation"))
    return g.edges.join(a, "source").join(b, "target").select("id", S.edge_type(F.lit(None).cast("string"), rel, F.col("source"), F.col("target"), F.col("ra"), F.lit("none"), F.col("cb")).alias("edge_type"))


register("k10_timescale", "SELECT a.k AS a, b.k AS b, CAST(a.i - b.i AS INT) AS diff FROM (SELECT unnest(['seconds','hours','years']) AS k, unnest([1,3,7]) AS i) a, (SELECT unnest(['minutes','decades']) AS k, unnest([2,8]) AS i) b")(
    lambda spark, sf: spark.createDataFrame([(a, b) for a in ("seconds", "hours", "years") for b in ("minutes", "decades")], "a string, b string").select("a", "b", S.compare_timescales(F.col("a"), F.col("b")).alias("diff"))
)


@register("k11_variant", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS magnitude, least(4.0, greatest(0.3, sqrt(p_size))) AS scale FROM part")
def _variant(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    vs = F.array(*[F.struct(F.lit(v).alias("id"), F.col("p_size").cast("double").alias("m") if v == "b" else F.lit(1.0).alias("m")) for v in "abc"])
    active = S.active_variant(vs, F.when(F.col("p_partkey") % 2 == 0, "b"), F.lit("b"))
    return part.select("p_partkey", active["m"].alias("magnitude"), S.variant_scale(active["m"]).alias("scale"))


on_trade("k12_overlay", "SELECT e.id, e.strength * CASE WHEN a.category = 'BOUNDARY' THEN 2.0 ELSE 1.0 END AS strength FROM edges e JOIN nodes a ON e.source = a.id")(
    lambda g: K.overlay(g.edges, g.nodes.where("category = 'BOUNDARY'").select(F.col("id").alias("node_id"), F.lit(2.0).alias("magnitude"))).select("id", "strength")
)
register("k13_risk", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'No effect' WHEN o_orderkey % 3 = 1 THEN CASE WHEN m >= 2 THEN 'Strong protection' WHEN m >= 1.5 THEN 'Moderate protection' ELSE 'Mild protection' END ELSE CASE WHEN m >= 3 THEN 'High risk' WHEN m >= 2 THEN 'Moderate risk' WHEN m >= 1.5 THEN 'Elevated risk' ELSE 'Slight risk' END END AS label FROM (SELECT o_orderkey, o_totalprice / 100000 AS m FROM orders) AS x")(
    lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", S.risk_label(F.col("o_totalprice") / 100000, F.when(F.col("o_orderkey") % 3 == 0, "neutral").when(F.col("o_orderkey") % 3 == 1, "protective").otherwise("risk")).alias("label"))
)
_FALL = lambda x, a, b: f"least(1.0, greatest(0.0, 1 - ({x} - {a}) / ({b} - {a}.0)))"


@register("k14_k15_cns_mpo", f"""WITH s AS (SELECT p_partkey, {_FALL("p_retailprice / 3", 360, 500)} + CASE WHEN p_size % 7 = 0 THEN 0.5 ELSE {_FALL("p_size / 10.0", 3, 5)} END + {_FALL("p_size * 2", 40, 90)} + {_FALL("p_size % 4", 0, 3)} + {_FALL("p_size % 12", 5, 10)} + {_FALL("p_size % 11", 5, 10)} AS score FROM part)
SELECT p_partkey, score, CASE WHEN p_partkey % 10 = 0 THEN 'none' WHEN score >= 4 THEN 'good' WHEN score >= 3 THEN 'moderate' ELSE 'poor' END AS bbb FROM s""")
def _mpo(spark, sf):
    c = F.col
    score = S.cns_mpo(c("p_retailprice") / 3, F.when(c("p_size") % 7 != 0, c("p_size") / 10.0), c("p_size") * 2, c("p_size") % 4, c("p_size") % 12, c("p_size") % 11)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", score.alias("score")).withColumn("bbb", S.bbb_class(c("score"), c("p_partkey") % 10 == 0))


on_trade("k16_styles", "SELECT id, CASE WHEN relation = 'increases' THEN '#4ade80' WHEN relation = 'decreases' THEN '#f87171' ELSE '#9ca3af' END AS color, 0.3 + conf_rank / 7 * 0.7 AS opacity, CASE WHEN conf_rank <= 1 THEN 2.5 WHEN conf_rank <= 3 THEN 2.0 WHEN conf_rank <= 5 THEN 1.5 ELSE 1.0 END::DOUBLE AS width FROM edges")(
    lambda g: g.edges.select("id", S.edge_color(F.col("relation")).alias("color"), S.level_opacity(F.col("causal_confidence")).alias("opacity"), S.stroke_width(F.col("conf_rank")).alias("width"))
)
register("k17_author_year", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]{4})', 1) AS INT) AS year, lower(split_part(c_name, '#', 1)) || '#' || split_part(c_name, '#', 2) AS author FROM customer")(
    lambda spark, sf: spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", S.extract_year(F.col("c_name")).alias("year"), S.normalize_author(F.concat(F.lit("J. A. "), F.col("c_name"), F.lit("."))).alias("author"))
)
_DOCS = "documents.parquet"
_TW = lambda t: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= 4))"
register("k18_title_similarity", f"WITH x AS (SELECT a.item_id AS a, b.item_id AS b, {_TW('a.text')} AS wa, {_TW('b.text')} AS wb FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id) SELECT a, b, CASE WHEN least(len(wa), len(wb)) = 0 THEN 1.0 ELSE len(list_intersect(wa, wb)) / least(len(wa), len(wb)) END AS similarity FROM x")(
    lambda spark, sf: (lambda b: b.toDF("a", "wa").join(b.toDF("b", "wb"), F.col("a") < F.col("b")).select("a", "b", S.title_set_similarity(F.col("wa"), F.col("wb")).alias("similarity")))(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", S.title_words(F.col("text"))))
)
_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
register("k19_keywords", f"""SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[()\\[\\]{{}}"'',;:!?.]', '', 'g'), '[-–—]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({_STOP})), lambda w: regexp_replace(w, 's$', ''))[1:8], ' ') AS keywords FROM benchmark""")(
    lambda spark, sf: spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.array_join(S.keywords(F.col("text")), " ").alias("keywords"))
)
_TK = lambda t: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9\\s_-]', '', 'g'), '[\\s_-]+'), lambda w: w <> ''))"
register("k20_word_overlap", f"WITH x AS (SELECT a.p_partkey AS a, b.n_name AS b, {_TK('a.p_name')} AS x, {_TK('b.n_name')} AS y FROM part a CROSS JOIN nation b) SELECT a, b, len(list_intersect(x, y)) / greatest(len(x), len(y)) AS overlap FROM x")(
    lambda spark, sf: _overlaps(spark, spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("ta")), spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("b"), F.col("n_name").alias("tb")))
)


def _overlaps(spark: SparkSession, many: DataFrame, few: DataFrame) -> DataFrame:
    """(a, b, overlap) of all pairs of many(a, ta) and few(b, tb).

    Tokens are found once a row.  The rows are far smaller than their pairs, so a file
    that is one task to read is dealt to all cores first.
    """
    x = many.repartition(3 * spark.sparkContext.defaultParallelism, "a").select("a", S.word_set(F.col("ta")).alias("x"))
    y = few.select("b", S.word_set(F.col("tb")).alias("y"))
    return x.crossJoin(F.broadcast(y)).select("a", "b", S.set_overlap(F.col("x"), F.col("y")).alias("overlap"))


register("k21_chemical_segments")(lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.to_json(S.chemical_segments(F.concat(F.lit("H2O Ca^2+ "), F.col("p_brand")))).alias("segments")))
on_trade("k22_node_type", "SELECT id, CASE subtype WHEN 'Cell' THEN 'cell' WHEN 'protein' THEN 'protein' ELSE 'default' END AS node_type FROM nodes")(lambda g: g.nodes.select("id", S.node_type(F.col("subtype"), {"cell": "cell", "protein": "protein"}, "default").alias("node_type")))

# ---- centrality

_DEG = "x AS (SELECT source AS n, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT target, 1, 0 FROM {e} UNION ALL SELECT id, 0, 0 FROM {n}) SELECT n AS node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS total, sum(i + o) / (SELECT count(*) - 1 FROM {n}) AS normalized FROM x GROUP BY n"
on_trade("a01_degree", ", " + _DEG.format(e="edges", n="nodes"))(A.degree)
register("a01_degree_supply", f"WITH nn AS ({G.SUPPLY_NODES}), ee AS ({G.SUPPLY_EDGES}), " + _DEG.format(e="ee", n="nn"))(lambda spark, sf: (lambda n, e: A.degree_of(n, e.toDF("src", "dst")))(*G.supply(spark, sf)))
on_trade("a02_node_degree", f"SELECT '{START}' AS id, count(*) AS degree FROM (SELECT source AS n FROM edges UNION ALL SELECT target FROM edges) AS x WHERE n = '{START}'")(lambda g: A.node_degree(g, START))
_DIST = """, d0(s, v, k) AS (SELECT id, id, 0 FROM nodes UNION SELECT s, target, k + 1 FROM d0 JOIN edges ON v = source WHERE k < 24), d AS (SELECT s, v, min(k) AS k FROM d0 GROUP BY s, v)"""
on_trade("a03_betweenness", _DIST + """, w(s, v, k) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT w.s, e.target, w.k + 1 FROM w JOIN edges e ON w.v = e.source JOIN d ON d.s = w.s AND d.v = e.target AND d.k = w.k + 1),
c AS (SELECT s, v, any_value(k) AS k, count(*) AS n FROM w GROUP BY s, v),
b AS (SELECT x.v, sum(x.n * y.n / t.n) AS b FROM c x JOIN c y ON x.v = y.s JOIN c t ON t.s = x.s AND t.v = y.v AND t.k = x.k + y.k WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v GROUP BY x.v)
SELECT id AS node_id, round(coalesce(b, 0) / ((SELECT count(*) FROM nodes) - 1.0) / ((SELECT count(*) FROM nodes) - 2), 9) AS score FROM nodes LEFT JOIN b ON id = v""", stored=True)(lambda g: A.betweenness(g).select("node_id", F.round("score", 9).alias("score")))  # fmt: skip
on_trade("a04_betweenness_weighted", stored=True)(lambda g: A.betweenness(g, weighted=True).select("node_id", F.round("score", 9).alias("score")))
on_trade("a05_closeness", _DIST + """, r AS (SELECT s, count(*) AS r, sum(k) AS t FROM d WHERE k > 0 GROUP BY s)
SELECT id AS node_id, coalesce(round(r / ((SELECT count(*) FROM nodes) - 1.0) * (r / t), 9), 0) AS score FROM nodes LEFT JOIN r ON id = s""", stored=True)(lambda g: A.closeness(g).select("node_id", F.round("score", 9).alias("score")))  # fmt: skip


def _pagerank_sql(nodes: str, edges: str, rounds: int) -> str:
    out = f"deg AS (SELECT source, count(*) AS k FROM {edges} GROUP BY source), p0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {nodes}) AS r FROM {nodes})"
    for i in range(1, rounds + 1):
        out += f""", f{i} AS (SELECT e.target AS t, sum(p.r / k) AS f FROM {edges} e JOIN deg ON e.source = deg.source JOIN p{i - 1} p ON p.id = e.source GROUP BY e.target),
p{i} AS (SELECT id, 0.15 / (SELECT count(*) FROM {nodes}) + 0.85 * (coalesce(f, 0) + (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT source FROM deg)) / (SELECT count(*) FROM {nodes})) AS r FROM p{i - 1} LEFT JOIN f{i} ON id = t)"""
    return out + f" SELECT id AS node_id, round(r, 9) AS score FROM p{rounds}"


on_trade("a06_pagerank", ", " + _pagerank_sql("nodes", "edges", 20), stored=True)(lambda g: A.pagerank(g.nodes, g.pairs(), max_iter=20, tol=None).select("node_id", F.round("score", 9).alias("score")))
register("a06_pagerank_supply", f"WITH nn AS ({G.SUPPLY_NODES}), ee AS ({G.SUPPLY_EDGES}), " + _pagerank_sql("nn", "ee", 5))(lambda spark, sf: (lambda n, e: A.pagerank(n, e.toDF("src", "dst"), max_iter=5, tol=None, simple=True).select("node_id", F.round("score", 9).alias("score")))(*G.supply(spark, sf)))
on_trade("a07_connectivity", ", m AS (SELECT DISTINCT module_id FROM nodes), x AS (SELECT a.module_id AS s, b.module_id AS t, count(*) AS n, avg(strength) AS w FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id GROUP BY 1, 2) SELECT a.module_id AS source_module, b.module_id AS target_module, coalesce(n, 0) AS edges, CASE WHEN n > 0 THEN CAST(CAST(CAST(round(w, 9) AS DECIMAL(18, 9)) AS DECIMAL(18, 2)) AS VARCHAR) ELSE '0' END AS avg_confidence FROM m a CROSS JOIN m b LEFT JOIN x ON a.module_id = s AND b.module_id = t")(A.module_connectivity)
on_trade("a08_modularity", ", e AS (SELECT x.*, a.module_id = b.module_id AS own FROM edges x JOIN nodes a ON x.source = a.id JOIN nodes b ON x.target = b.id), ko AS (SELECT source, count(*) AS k FROM edges GROUP BY 1), ki AS (SELECT target, count(*) AS k FROM edges GROUP BY 1) SELECT round(sum((1 - ko.k * ki.k / (SELECT count(*) FROM edges)) / (SELECT count(*) FROM edges)), 9) AS modularity FROM e JOIN ko ON e.source = ko.source JOIN ki ON e.target = ki.target WHERE own")(
    lambda g: A.modularity(g, g.nodes.select(F.col("id").alias("node_id"), F.col("module_id").alias("community"))).select(F.round("modularity", 9).alias("modularity"))
)
on_trade("a09_framework_stats", "SELECT 'category' AS kind, category AS value, count(*) AS n FROM nodes GROUP BY category UNION ALL SELECT 'role', role, count(*) FROM nodes WHERE role <> '' GROUP BY role UNION ALL SELECT 'level', causal_confidence, count(*) FROM edges GROUP BY 2")(A.framework_stats)

# ---- paths

_SP = f""", sp(node, path, eids, ss, dist) AS (SELECT '{START}', ['{START}'], CAST([] AS VARCHAR[]), CAST([] AS DOUBLE[]), CAST(0 AS DOUBLE)
UNION ALL SELECT e.target, list_append(path, e.target), list_append(eids, e.id), list_append(ss, e.strength), dist + e.distance FROM sp JOIN edges e ON sp.node = e.source WHERE NOT list_contains(path, e.target) AND len(path) <= 8)"""
_WEAK = "eids[list_position(ss, list_min(ss))] AS weakest_link"
_SHOW = lambda df, w="total_weight": df.select(F.array_join("path", ">").alias("path"), F.array_join("edges", ",").alias("edges"), F.round("total_weight", 6).alias("total_weight"), "weakest_link")
_SEL = "array_to_string(path, '>') AS path, array_to_string(eids, ',') AS edges"
on_trade("p01_shortest_path", _SP + f" SELECT {_SEL}, CAST(len(eids) AS DOUBLE) AS total_weight, {_WEAK} FROM sp WHERE node = '{END}' ORDER BY len(sp.path), sp.path LIMIT 1", stored=True)(lambda g: _SHOW(P.shortest_path(g, START, END)))
on_trade("p02_shortest_weighted", _SP + f" SELECT {_SEL}, round(dist, 6) AS total_weight, {_WEAK} FROM sp WHERE node = '{END}' ORDER BY round(dist, 12), len(sp.path), sp.path LIMIT 1", stored=True)(lambda g: _SHOW(P.shortest_path_weighted(g, START, END)))
on_trade("p03_strongest", _SP + f" SELECT max(list_min(ss)) AS bottleneck FROM sp WHERE node = '{END}'", stored=True)(lambda g: P.strongest_path(g, START, END).select(F.col("total_weight").alias("bottleneck")).groupBy().agg(F.max("bottleneck").alias("bottleneck")))
on_trade("p04_p05_simple_paths", _SP + f" SELECT {_SEL}, round(dist, 6) AS total_weight, {_WEAK} FROM sp WHERE node = '{END}' AND len(sp.path) <= 7", stored=True)(lambda g: _SHOW(P.all_simple_paths(g, START, END, 6)))
_REACH = lambda name, a, b, start, depth: f"{name}(node, depth) AS (SELECT {start}, 0 UNION SELECT e.{b}, depth + 1 FROM {name} JOIN edges e ON e.{a} = {name}.node WHERE depth < {depth})"
on_trade("p06_neighborhood", ", " + _REACH("up", "target", "source", f"'{START}'", 3) + ", " + _REACH("down", "source", "target", f"'{START}'", 3) + f" SELECT id AS node, id IN (SELECT node FROM up) AS upstream, id IN (SELECT node FROM down) AS downstream, id IN (SELECT node FROM up) AND id IN (SELECT node FROM down) AS bidirectional FROM nodes WHERE id <> '{START}' AND (id IN (SELECT node FROM up) OR id IN (SELECT node FROM down))", stored=True)(lambda g: P.neighborhood(g, START, 3))
on_trade("p07_k_hop", ", " + _REACH("r", "source", "target", f"'{START}'", 3) + " SELECT node, min(depth) AS depth FROM r GROUP BY node", stored=True)(lambda g: P.k_hop(g, START, 3))
_PATHWAY_OUT = lambda p: p["upstream"].select(F.lit("upstream").alias("part"), "id").unionByName(p["downstream"].select(F.lit("downstream").alias("part"), "id")).unionByName(p["modules"].select(F.lit("module").alias("part"), F.col("module_id").alias("id")))
_TARGET_SQL = "(SELECT unnest(['N03', 'N08', 'N99']))"


def _multi(name: str, a: str, b: str, depth: int) -> str:
    return f"{name}(node, depth) AS (SELECT t, 0 FROM tg UNION SELECT e.{b}, depth + 1 FROM {name} JOIN edges e ON e.{a} = {name}.node WHERE depth < {depth})"


_PW = ", tg AS (SELECT unnest({t}) AS t), " + _multi("up", "target", "source", 2) + ", " + _multi("down", "source", "target", 2) + ", u AS (SELECT DISTINCT node FROM up WHERE node NOT IN (SELECT t FROM tg)), w AS (SELECT DISTINCT node FROM down WHERE node NOT IN (SELECT t FROM tg))"
on_trade("p08_pathway", _PW.format(t=TARGETS) + " SELECT 'upstream' AS part, node AS id FROM u UNION ALL SELECT 'downstream', node FROM w UNION ALL SELECT DISTINCT 'module', module_id FROM nodes WHERE id IN (SELECT t FROM tg UNION SELECT node FROM u UNION SELECT node FROM w)", stored=True)(lambda g: _PATHWAY_OUT(P.pathway(g, TARGETS, 2)))
on_trade("p08_pathway_edges", stored=True)(lambda g: P.pathway(g, TARGETS, 2)["edges"])
_KNOWN = TARGETS[:2]
on_trade("p09_view_pathway", _PW.format(t=_KNOWN).replace("depth < 2", "depth < 3") + ", a AS (SELECT t AS n FROM tg UNION SELECT node FROM u UNION SELECT node FROM w) SELECT id FROM edges WHERE source IN (SELECT n FROM a) AND target IN (SELECT n FROM a)", stored=True)(lambda g: P.view_pathway(g, TARGETS, 3)["edges"])
_RED = """, r(eid, s, t, lim, cur, k) AS (SELECT e.id, e.source, e.target, e.conf_rank, f.target, 1 FROM edges e JOIN edges f ON f.source = e.source AND f.target <> e.target AND f.target <> e.source AND {c0}
UNION SELECT eid, s, t, lim, f.target, k + 1 FROM r JOIN edges f ON f.source = cur AND cur <> t AND f.target <> s AND {c1} WHERE k < 4) SELECT DISTINCT eid AS id FROM r WHERE cur = t"""
on_trade("p10_redundant_bottleneck", _RED.format(c0="f.conf_rank <= e.conf_rank", c1="f.conf_rank <= lim"), stored=True)(lambda g: P.redundant_edges(g, 4).select("id"))
on_trade("p10_redundant_as_built", _RED.format(c0="true", c1="true"), stored=True)(lambda g: P.redundant_edges(g, 4, "as_built").select("id"))
_PAIRS = [(f"N{a:02d}", f"N{(a * 7 + 3) % 25:02d}") for a in range(12)]
on_trade("p11_reachability", _DIST + ", q AS (SELECT unnest([" + ", ".join(f"'{a}'" for a, _ in _PAIRS) + "]) AS a, unnest([" + ", ".join(f"'{b}'" for _, b in _PAIRS) + "]) AS b) SELECT a AS start, b AS \"end\", k IS NOT NULL AS reachable, CAST(k AS INT) AS hops FROM q LEFT JOIN d ON s = a AND v = b", stored=True)(lambda g: P.reachability(g, _PAIRS))
_UND = ", u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)"
on_trade("p12_connected", _UND + f", r(n) AS (SELECT '{START}' UNION SELECT b FROM r JOIN u ON a = n) SELECT n AS node FROM r", stored=True)(lambda g: P.connected_nodes(g, START))

# ---- loops, components, robustness

_CYC = """, e AS (SELECT * FROM edges WHERE source <> target), c(s, node, path, eids, inh, worst) AS (SELECT source, target, [source, target], [id], CAST(is_inhibitory AS INT), conf_rank FROM e WHERE target > source
UNION ALL SELECT s, e.target, list_append(path, e.target), list_append(eids, id), inh + CAST(is_inhibitory AS INT), greatest(worst, conf_rank) FROM c JOIN e ON e.source = node WHERE e.target > s AND NOT list_contains(path, e.target) AND len(path) < 6)
SELECT array_to_string(path, '>') AS loop_id, CASE WHEN (inh + CAST(e.is_inhibitory AS INT)) % 2 = 0 THEN 'Reinforcing' ELSE 'Balancing' END AS polarity, 'L' || CAST(greatest(worst, e.conf_rank) AS VARCHAR) AS min_confidence, CAST(len(path) AS INT) AS length FROM c JOIN e ON e.source = node AND e.target = s"""
on_trade("l01_l02_feedback_loops", _CYC, stored=True)(lambda g: L.feedback_loops(g, 6).select("loop_id", "polarity", "min_confidence", F.size("nodes").alias("length")))
on_trade("l03_strong_components", ", r(a, b) AS (SELECT id, id FROM nodes UNION SELECT a, target FROM r JOIN edges ON b = source) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a", stored=True)(L.strong_components)
on_trade("l04_loops_by_node", f"SELECT 'out of ' || source AS id FROM edges GROUP BY source HAVING bool_or(source = '{END}' OR target = '{END}')")(
    lambda g: L.loops_by_node(g.edges.groupBy(F.concat(F.lit("out of "), F.col("source")).alias("id")).agg(F.collect_list("id").alias("edge_ids")), g.edges, END).select("id")
)




def _curated(g):
    """A loop document for each node with flows out, as JSON text, read back."""
    out = g.edges.groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("edgeIds"), F.max("conf_rank").alias("worst"))
    odd = F.col("worst") % 2 == 1
    loop = F.struct(
        F.concat(F.lit("loop_"), F.col("source")).alias("id"), F.when(odd, "balancing").otherwise("reinforcing").alias("type"), "edgeIds",
        F.when(odd, F.struct(F.col("source").alias("biomarker"), F.lit("early").alias("interventionWindow"))).alias("tippingPoint"),
    )
    text = out.select(F.to_json(F.struct(F.array(loop).alias("feedbackLoops"))).alias("value"))
    return SRC.from_loops(text.select(F.from_json("value", SRC.LOOPS).alias("d")).select("d.*"))


_CURATED = ", loops AS (SELECT 'loop_' || source AS id, CASE WHEN max(conf_rank) % 2 = 1 THEN 'balancing' ELSE 'reinforcing' END AS type, count(*) AS n_edges, CASE WHEN max(conf_rank) % 2 = 1 THEN source END AS tipping_biomarker, CASE WHEN max(conf_rank) % 2 = 1 THEN 'early' END AS intervention_window FROM edges GROUP BY source)"
on_trade("l05_curated_loops", _CURATED + " SELECT * FROM loops")(lambda g: _curated(g).select("id", "type", F.size("edge_ids").cast("bigint").alias("n_edges"), "tipping_biomarker", "intervention_window"))
on_trade("a09_loop_types", _CURATED + " SELECT 'loop' AS kind, type AS value, count(*) AS n FROM loops GROUP BY type")(lambda g: A.framework_stats(g, _curated(g)).where("kind = 'loop'"))
_COMP = lambda n, e: f"u AS (SELECT source AS a, target AS b FROM {e} UNION SELECT target, source FROM {e}), r(n, m) AS (SELECT id, id FROM {n} UNION SELECT n, b FROM r JOIN u ON a = m) SELECT n AS node, min(m) AS component FROM r GROUP BY n"
on_trade("c01_weak_components", ", " + _COMP("nodes", "edges"), stored=True)(lambda g: L.weak_components(g.nodes, g.pairs()))
register("c01_weak_components_hierarchy", f"WITH RECURSIVE ee AS ({G.HIERARCHY_EDGES}), r(n, m) AS (SELECT DISTINCT source, source FROM ee WHERE source LIKE 'r%' UNION SELECT e.target, r.m FROM r JOIN ee e ON e.source = r.n) SELECT m AS component, count(*) AS size FROM r GROUP BY m")(
    lambda spark, sf: _regions(checkpoint(G.hierarchy(spark, sf)))
)


def _regions(e: DataFrame) -> DataFrame:
    comp = L.weak_components(e.select(F.col("source").alias("id")).union(e.select("target")), e.toDF("src", "dst"), closed=True)
    heads = comp.where("node like 'r%'").select(F.col("node").alias("h"), "component")
    return comp.join(heads, "component").groupBy(F.col("h").alias("component")).agg(F.count(F.lit(1)).alias("size"))


on_trade("c02_filtered_components", VIEW + ", u AS (SELECT source AS a, target AS b FROM ve UNION SELECT target, source FROM ve), r(n, m) AS (SELECT id, id FROM v UNION SELECT n, b FROM r JOIN u ON a = m), c AS (SELECT n, min(m) AS component FROM r GROUP BY n) SELECT component, count(*) AS size FROM c GROUP BY component", stored=True)(lambda g: L.component_sizes(*B.view_filter(g, ["R0", "R2", "R3"], "moderate")))
on_trade("c03_c04_removal_impact", ", z AS (SELECT 'all' AS x UNION ALL SELECT id FROM nodes), u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), r(x, n, m) AS (SELECT x, id, id FROM nodes, z WHERE id <> x UNION SELECT x, n, b FROM r JOIN u ON a = m WHERE b <> x), c AS (SELECT x, n, min(m) AS c FROM r GROUP BY x, n), s AS (SELECT x, c, count(*) AS k FROM c GROUP BY x, c), t AS (SELECT x, count(*) AS n, max(k) AS big FROM s GROUP BY x) SELECT x AS removed, (SELECT n FROM t WHERE x = 'all') AS components_before, n AS components_after, (SELECT count(*) FROM nodes) - n AS largest_component_size, big AS largest_component_exact FROM t WHERE x <> 'all'", stored=True)(L.ranked_removal_impact)
on_trade("c05_communities", stored=True)(L.communities)
on_trade("c06_spectral", stored=True)(lambda g: Y.spectral_clusters(g, pinned=["R4"]))

# ---- layout and space


@register("y04_layers", f"WITH RECURSIVE ee AS ({G.HIERARCHY_EDGES}), nn AS (SELECT source AS id FROM ee UNION SELECT target FROM ee), r(id, layer) AS (SELECT id, 0 FROM nn WHERE id NOT IN (SELECT target FROM ee) UNION SELECT e.target, layer + 1 FROM r JOIN ee e ON e.source = r.id) SELECT id, max(layer) AS layer FROM r GROUP BY id")
def _layers(spark, sf):
    e = checkpoint(G.hierarchy(spark, sf))
    return Y.longest_path_layers(e.select(F.col("source").alias("id")).union(e.select("target")).distinct(), e.toDF("src", "dst"))


_LAYER = "CAST(ord % 6 AS INT)"
on_trade("y05_ghosts", f""", l AS (SELECT id, {_LAYER} AS layer FROM nodes), s AS (SELECT e.id, e.ord, least(a.layer, b.layer) AS lo, greatest(a.layer, b.layer) AS hi FROM edges e JOIN l a ON e.source = a.id JOIN l b ON e.target = b.id),
n AS (SELECT *, coalesce(sum(greatest(hi - lo - 1, 0)) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), x AS (SELECT *, unnest(range(lo + 1, hi)) AS layer FROM n)
SELECT '__ghost_' || id || '_' || CAST(CAST(before + layer - lo AS BIGINT) AS VARCHAR) AS id, CAST(layer AS INT) AS layer, id AS original_edge_id FROM x""")(lambda g: Y.ghost_nodes(g.edges, g.nodes.select("id", (F.col("ord") % 6).cast("int").alias("layer")))[0])  # fmt: skip
on_trade("y05_segments")(lambda g: Y.ghost_nodes(g.edges, g.nodes.select("id", (F.col("ord") % 6).cast("int").alias("layer")))[1])
_PLACES = "p AS (SELECT id, ord % 6 AS layer, row_number() OVER (PARTITION BY ord % 6 ORDER BY id) - 1 AS position FROM nodes)"


def _places(g):
    from pyspark.sql.window import Window as W

    return g.nodes.select("id", (F.col("ord") % 6).alias("layer"), (F.row_number().over(W.partitionBy(F.col("ord") % 6).orderBy("id")) - 1).cast("bigint").alias("position"))


on_trade("y07_crossings", f", {_PLACES}, s AS (SELECT CASE WHEN a.layer < b.layer THEN a.layer ELSE b.layer END AS layer, CASE WHEN a.layer < b.layer THEN a.position ELSE b.position END AS u, CASE WHEN a.layer < b.layer THEN b.position ELSE a.position END AS v FROM edges e JOIN p a ON e.source = a.id JOIN p b ON e.target = b.id WHERE abs(a.layer - b.layer) = 1) SELECT x.layer, count(*) AS crossings FROM s x JOIN s y ON x.layer = y.layer AND x.u < y.u AND x.v > y.v GROUP BY x.layer")(
    lambda g: Y.crossing_count(g.edges.select(F.col("source").alias("from_id"), F.col("target").alias("to_id")), _places(g))
)
on_trade("y08_coordinates", f", {_PLACES}, w AS (SELECT layer, count(*) AS w FROM p GROUP BY layer), c AS (SELECT id, p.layer, position, ((SELECT max(w) FROM w) - w) / 2 * 70.0 + position * 70.0 AS x, p.layer * 250.0 AS y FROM p JOIN w ON p.layer = w.layer) SELECT id, CAST(x - (SELECT min(x) FROM c) AS DOUBLE) AS x, CAST(y - (SELECT min(y) FROM c) AS DOUBLE) AS y, layer, position FROM c")(lambda g: Y.coordinates(_places(g)))
on_trade("y01_y09_flat_layout", stored=True)(lambda g: Y.flat_layout(g))
on_trade("y02_layout_subgraph", stored=True)(lambda g: Y.layout_subgraph(g, g.nodes.where("ord < 12").select("id")))
on_trade("y10_spectral_clusters", stored=True)(lambda g: Y.spectral_clusters(g))
on_trade("y11_module_clusters", "SELECT id, dense_rank() OVER (ORDER BY (SELECT min(m.ord) FROM nodes m WHERE m.module_id = n.module_id)) - 1 AS cluster FROM nodes n")(Y.module_clusters)
on_trade("y12_diagnostics", ", c AS (SELECT id, module_id, ord % 4 AS cluster FROM nodes), n AS (SELECT cluster, module_id, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT cluster, max(n) AS top, sum(n) AS size, count(*) AS mods FROM n GROUP BY 1) SELECT count(*) AS k, round(sum(top) / sum(size), 3) AS module_agreement, count(*) FILTER (mods > 1) AS mixed_clusters, (SELECT count(*) FROM (SELECT module_id FROM n GROUP BY 1 HAVING count(*) > 1) AS q) AS modules_split, (SELECT round(count(*) FILTER (a.cluster <> b.cluster) / count(*), 3) FROM edges e JOIN c a ON e.source = a.id JOIN c b ON e.target = b.id) AS cross_cluster_edge_ratio FROM p")(
    lambda g: Y.diagnostics(g, g.nodes.select("id", (F.col("ord") % 4).alias("cluster")))
)
on_trade("y13_hierarchical", stored=True)(lambda g: Y.hierarchical_layout(g, Y.module_clusters(g))[0])
on_trade("y14_columns", """, q AS (SELECT id, module_id AS layer, CAST(ord AS DOUBLE) AS y FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY y, id) - 1 AS r FROM q), s AS (SELECT layer, count(*) AS n FROM q GROUP BY layer),
t AS (SELECT layer, n, coalesce(sum(floor((n - 1) / 3) * 200 + 280) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT id, CAST(start + floor(r / 3) * 200 AS DOUBLE) AS x, CAST((r % 3) * 70 - (least(3, n - floor(r / 3) * 3) - 1) * 70 / 2 AS DOUBLE) AS y FROM r JOIN t ON r.layer = t.layer""")(lambda g: Y.split_columns(g.nodes.select("id", F.col("module_id").alias("layer"), F.col("ord").cast("double").alias("y")), most=3))  # fmt: skip


@register("y15_kahn_levels", SQL["y04_layers"].replace("layer", "level"))
def _kahn(spark, sf):
    e = checkpoint(G.hierarchy(spark, sf))
    return Y.kahn_levels(e.select(F.col("source").alias("id")).union(e.select("target")).distinct(), e.toDF("src", "dst"))


on_trade("y17_back_routes")(lambda g: Y.back_edge_routes(g.edges, Y.coordinates(_places(g), left_to_right=True)))
on_trade("y18_placed", "SELECT id, label, CAST(CASE WHEN ord < 10 THEN ord * 5 ELSE 0 END AS DOUBLE) AS x, CAST(CASE WHEN ord < 10 THEN ord ELSE 0 END AS DOUBLE) AS y FROM nodes")(lambda g: Y.placed(g, g.nodes.where("ord < 10").select("id", (F.col("ord") * 5.0).alias("x"), (F.col("ord") * 1.0).alias("y"))))
on_trade("y18_routed")(lambda g: Y.routed_edges(Y.ghost_nodes(g.edges, g.nodes.select("id", (F.col("ord") % 6).cast("int").alias("layer")))[1], g.edges))
register("y20_eigen_view", "SELECT i, v AS value, v - lag(v) OVER (ORDER BY i) AS gap, i = 3 AS chosen FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i, CAST(unnest([0, 0.1, 0.2, 0.9, 1.0]) AS DOUBLE) AS v) AS x")(
    lambda spark, sf: Y.eigenvalue_view(spark.createDataFrame(list(enumerate([0.0, 0.1, 0.2, 0.9, 1.0])), "i int, value double"), 3)
)
_PTS = lambda spark, sf: spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
register("q01_box", "SELECT c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 100 AND 2500 AND c_nationkey BETWEEN 3 AND 11")(lambda spark, sf: Y.within(_PTS(spark, sf), 100, 3, 2500, 11).select("id"))
on_trade("q02_viewport", "SELECT id FROM nodes WHERE ord * 300 BETWEEN 100 AND 3500")(lambda g: Y.viewport(g.nodes.select("id", (F.col("ord") * 300.0).alias("x"), F.lit(0.0).alias("y")), g.edges, (620.0, 0.0, 2980.0, 50.0), threshold=10)[0].select("id"))
on_trade("q03_focus", "SELECT id, source IN ('N00', 'N01', 'N02', 'N03') AND target IN ('N00', 'N01', 'N02', 'N03') OR id = 'E05_09' AS focused FROM edges")(lambda g: Y.step_focus(g.edges, ["N00", "N01", "N02", "N03"], ["E05_09"]))

# ---- audits and citations

@on_trade("d01_audit", """, an AS (SELECT id, module_id FROM nodes WHERE ord <> 3 UNION ALL SELECT id, module_id FROM nodes WHERE ord % 7 = 0),
ae AS (SELECT id, CASE WHEN ord % 11 = 0 THEN 'X' ELSE source END AS source, CASE WHEN ord % 13 = 0 THEN source WHEN ord % 5 = 0 THEN 'Y' ELSE target END AS target FROM edges UNION ALL SELECT id, source, target FROM edges WHERE ord % 3 = 0)
SELECT 'duplicate_node' AS issue, id FROM an GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_edge', id FROM ae GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'unknown_module', id FROM an WHERE module_id = 'R4' UNION ALL SELECT 'broken_source', id FROM ae WHERE source NOT IN (SELECT id FROM an)
UNION ALL SELECT 'broken_target', id FROM ae WHERE target NOT IN (SELECT id FROM an) UNION ALL SELECT 'orphan', id FROM an WHERE id NOT IN (SELECT source FROM ae UNION SELECT target FROM ae)
UNION ALL SELECT 'self_loop', id FROM ae WHERE source = target""")
def _audit(g):
    """The trade graph with seeded defects."""
    nodes = g.nodes.where("ord <> 3").unionByName(g.nodes.where("ord % 7 = 0"))
    source = F.when(F.col("ord") % 11 == 0, "X").otherwise(F.col("source"))
    target = F.when(F.col("ord") % 13 == 0, F.col("source")).when(F.col("ord") % 5 == 0, "Y").otherwise(F.col("target"))
    edges = g.edges.select(*[{"source": source, "target": target}.get(c, F.col(c)).alias(c) for c in g.edges.columns]).unionByName(g.edges.where("ord % 3 = 0"))
    modules = g.nodes.select(F.col("module_id").alias("id")).where("id <> 'R4'").distinct()
    return D.audit(G.CausalGraph(nodes, edges, modules, checked_edges=edges))


on_trade("d02_without_incoming", "SELECT id, module_id FROM nodes WHERE id NOT IN (SELECT target FROM edges)")(D.without_incoming)
on_trade("d03_citations", "SELECT count(*) AS edges, count(*) FILTER (pmid <> '') AS with_pmid, count(first_author) AS with_first_author, count(year) AS with_year, count(mechanism_description) AS with_mechanism_description, count(method_type) AS with_method_type, count(*) FILTER (pmid <> '' AND first_author IS NOT NULL AND year IS NOT NULL AND method_type IS NOT NULL) AS fully_cited FROM edges")(lambda g: D.citation_coverage(g.edges))
on_trade("d03_missing_by_level", "SELECT causal_confidence, count(*) AS edges, count(*) FILTER (coalesce(pmid, '') = '') AS without_pmid FROM edges GROUP BY 1")(lambda g: D.missing_by_level(g.edges))
on_trade("d04_method_survey", "SELECT coalesce(method_type, '') AS method, " + ", ".join(f"count(*) FILTER (causal_confidence = '{x}') AS {x}" for x in K.LEVELS) + " FROM edges GROUP BY 1")(lambda g: D.method_survey(g.edges))
on_trade("d04_case_variants", "SELECT lower(method_type) AS method, string_agg(DISTINCT method_type, ',' ORDER BY method_type) AS spellings FROM edges WHERE method_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT method_type) > 1")(lambda g: D.case_variants(g.edges))
on_trade("d04_scheme_mismatches", f", x AS (SELECT id, method_type, causal_confidence, CASE lower(method_type) {_METHODS} ELSE 'L7' END AS expected FROM edges WHERE method_type IS NOT NULL) SELECT * FROM x WHERE expected <> causal_confidence")(lambda g: D.scheme_mismatches(g.edges, K.AUDIT_MAP))
on_trade("d05_verified_summary", "SELECT causal_confidence, relation, count(*) AS edges, count(*) FILTER (coalesce(pmid, '') <> '') AS with_pmid FROM edges GROUP BY 1, 2")(lambda g: D.verified_summary(g.edges))
_PUB = "pub AS (SELECT DISTINCT pmid, 'Author' || CAST(CAST(pmid AS BIGINT) % 3 AS VARCHAR) AS first_author, CAST(1990 + CAST(pmid AS BIGINT) % 30 AS INT) AS year FROM edges WHERE pmid <> '')"


def _pubmed(g):
    n = F.col("pmid").cast("bigint")
    return g.edges.where("pmid <> ''").select("pmid", F.concat(F.lit("Author"), (n % 3).cast("string")).alias("first_author"), (1990 + n % 30).cast("int").alias("year"), F.lit("common title words").alias("title")).distinct()


on_trade("d06_compare_sources", f", {_PUB} SELECT e.id, CASE WHEN e.first_author IS NOT NULL AND e.first_author <> pub.first_author THEN 'author' ELSE '' END || CASE WHEN e.first_author IS NOT NULL AND e.first_author <> pub.first_author AND abs(e.year - pub.year) > 1 THEN ',' ELSE '' END || CASE WHEN abs(e.year - pub.year) > 1 THEN 'year' ELSE '' END AS issues, CASE WHEN CAST(e.pmid AS BIGINT) % 2 = 0 THEN 'year_gap' ELSE '' END AS warnings FROM edges e JOIN pub ON e.pmid = pub.pmid")(
    lambda g: (lambda p: D.compare_sources(g.edges, p, p.select("pmid", "title", F.when(F.col("pmid").cast("bigint") % 2 == 0, F.col("year") + 5).otherwise(F.col("year")).alias("year"))))(_pubmed(g))
)
on_trade("d07_enrich", f", {_PUB} SELECT e.id, coalesce(e.first_author, pub.first_author) AS first_author, coalesce(e.year, pub.year) AS year FROM edges e LEFT JOIN pub ON e.pmid = pub.pmid")(lambda g: D.enrich(g.edges, _pubmed(g)).select("id", "first_author", "year"))


@register("d08_repair")
def _repair(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("k"), "text")
    wanted = b.select(F.col("k").alias("id"), F.col("text").alias("title"), F.concat(F.lit("Author"), F.col("k")).alias("author"), (1990 + F.col("k") % 9).alias("year"))
    # All items that share a word with the wanted title are its candidates.
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("w")
    pairs = b.select(F.col("k").alias("id"), word).join(b.select("k", word), "w").where("w <> ''").select("id", "k").distinct()
    cands = pairs.join(b, "k").select("id", F.col("k").alias("ord"), F.col("k").cast("string").alias("pmid"), F.col("text").alias("title"), F.concat(F.lit("Author"), F.col("k")).alias("author"), (1990 + F.col("k") % 9).alias("year"))
    return D.repair_candidates(wanted, cands)


register("d09_metrics", "WITH o AS (SELECT o_orderpriority AS p, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT p, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 4) AS mean, median(v) AS median, max(v) FILTER (r = floor(n * 0.25)) AS p25, max(v) FILTER (r = floor(n * 0.75)) AS p75 FROM o GROUP BY p")(
    lambda spark, sf: D.metrics(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("value")), ["p"]).withColumn("mean", F.round("mean", 4))
)
register("d09_most_cited", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place, o_orderkey AS id, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(
    lambda spark, sf: D.most_cited(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")))
)
_SIMPLE = lambda: F.struct(F.array(F.struct("id", "source", "target", "relation")).alias("edges"))
on_trade("s04_simple_json", "SELECT CASE WHEN ord % 2 = 0 THEN id ELSE 'e_' || source || '_' || target || '_0' END AS id, source, target, CASE WHEN ord % 3 = 0 THEN 'association' ELSE relation END AS relation, 'default' AS module_id, 'L7' AS causal_confidence FROM edges")(
    lambda g: SRC.from_simple(g.edges.select(F.when(F.col("ord") % 2 == 0, F.col("id")).alias("id"), "source", "target", F.when(F.col("ord") % 3 != 0, F.col("relation")).alias("relation")).select(F.from_json(F.to_json(_SIMPLE()), SRC.SIMPLE).alias("d")).select("d.*")).edges.select("id", "source", "target", "relation", "module_id", "causal_confidence")
)
on_trade("s12_view_state", "SELECT id, CASE WHEN ord % 3 = 0 THEN 'strong' END AS filter, id AS selected FROM nodes WHERE ord % 4 <> 0")(
    lambda g: g.nodes.select("id", SRC.view_state(F.to_json(F.struct(F.when(F.col("ord") % 4 != 0, "1").alias("version"), F.when(F.col("ord") % 3 == 0, "strong").otherwise("odd").alias("evidenceFilter"), F.col("id").alias("selectedNode")))).alias("v")).where("v is not null").select("id", F.col("v.evidenceFilter").alias("filter"), F.col("v.selectedNode").alias("selected"))
)
on_trade("d10_verdicts", "SELECT CASE WHEN ord % 3 = 0 THEN 'pending' WHEN ord % 3 = 1 THEN 'supported' ELSE 'refuted' END AS verdict, count(*) AS n FROM edges GROUP BY 1")(lambda g: D.verdict_tally(g.edges.select("id"), g.edges.where("ord % 3 <> 0").select("id", F.when(F.col("ord") % 3 == 1, "supported").otherwise("refuted").alias("verdict"))))
on_trade("d11_patch_pmids", "SELECT id, CASE WHEN ord % 2 = 0 AND pmid <> '' THEN '1' ELSE pmid END AS pmid FROM edges")(lambda g: D.patch_pmids(g.edges, g.edges.where("pmid <> ''").select("id", F.when(F.col("ord") % 2 == 0, F.col("pmid")).otherwise("other").alias("old_pmid"), F.lit("1").alias("new_pmid"))).select("id", "pmid"))
register("d12_sentences", "WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: length(w) > 4)) AS ws, string_split(text, '. ') AS ss FROM benchmark), s AS (SELECT item_id, ws, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM t), c AS (SELECT item_id, k, len(list_filter(ws, lambda w: contains(lower(s), w))) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) AS rn FROM c) SELECT item_id AS id, CAST(score AS INT) AS score FROM r WHERE rn = 1")(
    lambda spark, sf: D.supporting_sentence(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("claim"), F.col("text").alias("abstract"))).select("id", "score")
)
on_trade("d13_cache", "SELECT id FROM edges WHERE ord % 4 <> 0")(lambda g: (lambda r: D.split_cached(r, r.where("ord % 4 = 0").select(D.cache_key(F.col("claims"), F.col("abstract")).alias("key"), F.lit("supported").alias("verdict")))[1].select("id"))(g.edges.select("id", "ord", F.array("id", "relation").alias("claims"), F.col("id").alias("abstract"))))

# ---- reconciliation


@on_trade("m01_map_ids")
def _m01(g):
    new = g.nodes.select("id", "label", "module_id", "ord")
    old = new.select(F.when(F.col("ord") % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("old_"), F.col("id"))).alias("id"), F.when(F.col("ord") % 3 == 1, F.upper("label")).otherwise(F.concat("label", F.lit(" nation"))).alias("label"), "module_id", "ord")
    return D.map_ids(old, new, fuzzy=0.5)


@on_trade("m02_map_stepwise", "SELECT CASE WHEN ord % 4 = 0 THEN id WHEN ord % 4 = 1 THEN lower(id) WHEN ord % 4 = 2 THEN 'x' || id ELSE 'N_' || substr(id, 2) END AS old_id, id AS new_id, CASE WHEN ord % 4 = 0 THEN 'exact' WHEN ord % 4 = 1 THEN 'case_insensitive' WHEN ord % 4 = 2 THEN 'label' ELSE 'stripped' END AS match_type FROM nodes")
def _m02(g):
    k = F.col("ord") % 4
    old = g.nodes.select(F.when(k == 0, F.col("id")).when(k == 1, F.lower("id")).when(k == 2, F.concat(F.lit("x"), F.col("id"))).otherwise(F.concat(F.lit("N_"), F.substring("id", 2, 9))).alias("id"), F.when(k == 2, F.lower("label")).otherwise("none").alias("label"))
    return D.map_ids_stepwise(old, g.nodes, g.nodes.sparkSession.createDataFrame([], "old_id string, new_id string"))


@on_trade("m03_translate", ", x AS (SELECT e.id, a.id AS source, b.id AS target, e.pmid, e.ord FROM edges e LEFT JOIN nodes a ON e.source = a.id AND a.ord % 11 <> 0 LEFT JOIN nodes b ON e.target = b.id AND b.ord % 11 <> 0) SELECT x.id, x.source, x.target, CASE WHEN x.source IS NULL OR x.target IS NULL THEN 'unmapped' WHEN c.id IS NOT NULL AND coalesce(x.pmid, '') <> '' THEN 'citation_only' WHEN c.id IS NOT NULL THEN 'duplicate' ELSE 'new_edge' END AS status FROM x LEFT JOIN edges c ON c.source = x.source AND c.target = x.target AND c.ord % 2 = 0")
def _m03(g):
    ids = g.nodes.where("ord % 11 <> 0").select(F.concat(F.lit("o"), F.col("id")).alias("old_id"), F.col("id").alias("new_id"))
    old = g.edges.select("id", F.concat(F.lit("o"), F.col("source")).alias("source"), F.concat(F.lit("o"), F.col("target")).alias("target"), "pmid", "ord")
    return D.translate_edges(old, ids, g.edges.where("ord % 2 = 0").select("source", "target", F.lit("").alias("pmid")))


_REC = ["id", "source", "target", "relation", "pmid", "first_author", "year"]
on_trade("m04_apply_recovered", "SELECT CASE WHEN ord % 2 = 0 THEN id ELSE 'REC.' || lpad(CAST(row_number() OVER (PARTITION BY ord % 2 ORDER BY ord) AS VARCHAR), 3, '0') END AS id, source, target, relation, pmid FROM edges")(
    lambda g: D.apply_recovered(g.edges.where("ord % 2 = 0").select(*_REC).unionByName(g.edges.where("ord % 2 = 1").select("id", F.lit("none").alias("source"), F.col("id").alias("target"), "relation", "pmid", "first_author", "year")), g.edges.where("ord % 2 = 1").select(*_REC, "ord")).where("source <> 'none'").select("id", "source", "target", "relation", "pmid")
)


@on_trade("m05_integrate", """, v AS (SELECT ord, 0 AS k, CASE WHEN ord % 3 = 1 THEN target ELSE source END AS s, CASE WHEN ord % 3 = 1 THEN source ELSE target END AS t, relation FROM edges WHERE ord % 2 = 1 UNION ALL SELECT ord, 1, target, source, relation FROM edges WHERE ord % 2 = 1 AND ord % 3 = 2),
n AS (SELECT * FROM v WHERE (s, t) NOT IN (SELECT (source, target) FROM edges WHERE ord % 2 = 0)), f AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY ord, k) AS rn FROM n)
SELECT 'V' || lpad(CAST(row_number() OVER (ORDER BY ord, k) AS VARCHAR), 4, '0') AS id, s AS source, t AS target, relation FROM f WHERE rn = 1""")
def _m05(g):
    way = F.when(F.col("ord") % 3 == 1, "reverse").when(F.col("ord") % 3 == 2, "bidirectional").otherwise("forward")
    v = g.edges.select("ord", "source", "target", (F.col("ord") % 2 == 1).alias("supported"), way.alias("direction"), "relation", "method_type", F.col("causal_confidence").alias("confidence"))
    return D.integrate_verified(v, g.nodes, g.edges.where("ord % 2 = 0")).select("id", "source", "target", "relation")


on_trade("m06_append_missing", "SELECT id FROM edges")(lambda g: D.append_missing(g.edges.where("ord % 2 = 0").select("id", "source"), g.edges.select("id", "target")).select("id"))
register("m07_compare", "WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 1 AND o_orderpriority <> '5-LOW') SELECT coalesce(x.p, y.p) AS o_orderpriority, coalesce(x.n, 0) AS n_old, coalesce(y.n, 0) AS n_new, (SELECT count(*) FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderpriority = coalesce(x.p, y.p)) AS shared, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM (SELECT o_orderpriority AS p, count(*) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM b GROUP BY 1) y ON x.p = y.p")(
    lambda spark, sf: (lambda o: D.compare(o.where("id % 3 <> 0"), o.where("id % 3 <> 1 and o_orderpriority <> '5-LOW'"), "o_orderpriority"))(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderpriority"))
)
_OVERLAP = lambda kind, cols, a, b: f"SELECT '{kind}' AS kind, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {a})) AS n_old, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {b})) AS n_new, (SELECT count(*) FROM (SELECT {cols} FROM {a} INTERSECT SELECT {cols} FROM {b})) AS shared, (SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT SELECT {cols} FROM {b})) AS only_old, (SELECT count(*) FROM (SELECT {cols} FROM {b} EXCEPT SELECT {cols} FROM {a})) AS only_new"
_PARTS = "(SELECT * FROM edges WHERE ord % 3 <> 0)", "(SELECT * FROM edges WHERE ord % 3 <> 1)"
on_trade("m07_compare_graphs", " UNION ALL ".join([_OVERLAP("nodes", "id", "nodes", "(SELECT * FROM nodes WHERE id <> 'N00')"), _OVERLAP("edges", "id", *_PARTS), _OVERLAP("pairs", "source, target", *_PARTS)]))(
    lambda g: D.compare_graphs(g.update(g.nodes, g.edges.where("ord % 3 <> 0")), g.update(g.nodes.where("id <> 'N00'"), g.edges.where("ord % 3 <> 1")))
)
on_trade("m07_summary", ", part AS (SELECT * FROM edges WHERE ord % 7 = 0) SELECT n AS nodes, m AS edges, o AS orphans, round(100.0 * o / n, 1) AS orphan_pct, round(CAST(m AS DOUBLE) / n, 2) AS edges_per_node, c AS cited, round(100.0 * c / m, 1) AS cited_pct FROM (SELECT count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM part WHERE source = nodes.id OR target = nodes.id)) AS o FROM nodes) CROSS JOIN (SELECT count(*) AS m, count(*) FILTER (pmid <> '') AS c FROM part)")(lambda g: D.summary(g.update(g.nodes, g.edges.where("ord % 7 = 0"))))
on_trade("m08_candidate_pairs", "SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id < y.id WHERE x.module_id = y.module_id AND NOT EXISTS (SELECT 1 FROM edges WHERE (source = x.id AND target = y.id) OR (source = y.id AND target = x.id))")(
    lambda g: D.candidate_pairs(g.nodes.select(F.col("id").alias("source"), "module_id").join(g.nodes.select(F.col("id").alias("target"), "module_id"), "module_id").select("source", "target"), g.edges)
)
on_trade("m09_next_batch", "SELECT id FROM edges WHERE ord % 2 = 1 ORDER BY ord LIMIT 10")(lambda g: D.next_batch(g.edges, g.edges.where("ord % 2 = 0").select("id"), 10).select("id"))
on_trade("m10_delete", f"SELECT id FROM nodes WHERE id <> '{START}'")(lambda g: D.delete_row(g.nodes, START).select("id"))

# ---- catalogs

_TREAT = """tr AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'trial' ELSE 'preclinical' END AS fda_status, 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS n1, 'N' || lpad(CAST((s_nationkey + 7) % 25 AS VARCHAR), 2, '0') AS n2, s_suppkey % 2 = 0 AS stops FROM supplier)"""


def _treatments(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n = lambda c: F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))
    effect = F.when(F.col("s_suppkey") % 2 == 0, "inhibits").otherwise("activates").alias("effect")
    targets = F.array(F.struct(n(F.col("s_nationkey")).alias("node_id"), effect), F.struct(n((F.col("s_nationkey") + 7) % 25).alias("node_id"), effect))
    status = F.when(F.col("s_suppkey") % 3 == 0, "approved").when(F.col("s_suppkey") % 3 == 1, "trial").otherwise("preclinical")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), status.alias("fda_status"), targets.alias("primary_targets"), F.col("s_suppkey").alias("ord"), F.array(F.struct(F.lit("low").alias("name"), F.lit(0.5).alias("multiplier")), F.struct(F.lit("full").alias("name"), F.lit(1.0).alias("multiplier"))).alias("variants"))


def _presets(spark, sf):
    n = lambda c: F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))
    return spark.range(8).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "protocol").otherwise("hypothesis").alias("category"), F.transform(F.sequence(F.lit(1), F.greatest(F.col("id"), F.lit(1))), lambda x: x.cast("bigint")).alias("treatment_ids"), F.array(n(F.col("id")), n(F.col("id") + 9)).alias("node_ids"), (F.col("id") % 2 == 1).alias("hypothesis"), F.col("id").alias("ord"))


register("t01_by_status", f"WITH {_TREAT} SELECT id FROM tr WHERE fda_status = 'approved'")(lambda spark, sf: T.treatments_by(_treatments(spark, sf), fda_status="approved").select("id"))
register("t02_inhibitors", f"WITH {_TREAT} SELECT id FROM tr WHERE stops AND (n1 = 'N05' OR n2 = 'N05')")(lambda spark, sf: T.inhibitors(_treatments(spark, sf), "N05").select("id"))
register("t03_target_nodes", f"WITH {_TREAT} SELECT n1 AS node_id FROM tr UNION SELECT n2 FROM tr")(lambda spark, sf: T.target_nodes(_treatments(spark, sf)))
register("t04_preset_treatments", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey BETWEEN 1 AND 5")(lambda spark, sf: T.treatments_of_preset(_presets(spark, sf), _treatments(spark, sf), "5").select("id"))
register("t05_preset_modules", "SELECT DISTINCT 'R' || CAST(n_regionkey AS VARCHAR) AS module_id FROM nation WHERE n_nationkey IN (3, 12)")(lambda spark, sf: T.modules_of_preset(G.trade(spark, sf), _presets(spark, sf), "3"))
_BIO = lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("years_before_symptoms"), F.col("p_type").alias("method"), F.col("p_partkey").alias("ord"))
register("t06_detectable", "SELECT p_partkey AS node_id, p_size AS years_before_symptoms FROM part WHERE p_size >= 20")(lambda spark, sf: T.detectable(_BIO(spark, sf), 20).select("node_id", "years_before_symptoms"))
register("t07_select_preset", f"WITH {_TREAT} SELECT DISTINCT n AS id FROM (SELECT n1 AS n FROM tr WHERE id <= 4 AND id >= 1 UNION SELECT n2 FROM tr WHERE id <= 4 AND id >= 1) AS x")(lambda spark, sf: T.select_preset(G.trade(spark, sf), _presets(spark, sf), _treatments(spark, sf), "4"))
on_trade("t08_pathway_counts", _PW.format(t=_KNOWN).replace("depth < 2", "depth < 3") + " SELECT 'targets' AS part, count(*) AS n FROM tg UNION ALL SELECT 'upstream', count(*) FROM u UNION ALL SELECT 'downstream', count(*) FROM w UNION ALL SELECT 'modules', count(DISTINCT module_id) FROM nodes WHERE id IN (SELECT t FROM tg UNION SELECT node FROM u UNION SELECT node FROM w)", stored=True)(lambda g: T.pathway_counts(P.view_pathway(g, TARGETS, 3)))
register("t09_dose_effect", "SELECT s_suppkey AS id, v AS variant, CAST(m AS DOUBLE) AS multiplier FROM supplier, (SELECT unnest(['low', 'full']) AS v, unnest([0.5, 1.0]) AS m) AS x")(lambda spark, sf: T.dose_effect(_treatments(spark, sf)))

# ---- sources and sinks

register("page_links", "SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) AS x GROUP BY 1, 2")(lambda spark, sf: SRC.page_links(spark.read.parquet(f"{sf}/pages.parquet")))
@register("s11_abstracts", "SELECT CAST(item_id AS VARCHAR) AS pmid, CASE WHEN item_id % 4 <> 1 THEN trim(text) || CASE WHEN item_id % 4 = 2 THEN ' and more' ELSE '' END END AS abstract FROM benchmark")
def _abstracts(spark, sf):
    """Items as articles of two to a response, some with a second part, some unanswered."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    more = F.when(F.col("item_id") % 4 == 2, "<AbstractText Label='R'><i>and</i> more</AbstractText>").otherwise("")
    article = F.concat(F.lit("<PubmedArticle><PMID Version='1'>"), F.col("item_id").cast("string"), F.lit("</PMID><Abstract><AbstractText>"), "text", F.lit("</AbstractText>"), more, F.lit("</Abstract></PubmedArticle>"))
    answers = items.where("item_id % 4 <> 1").groupBy(F.floor(F.col("item_id") / 2)).agg(F.array_join(F.collect_list(article), "\n").alias("value"))
    return SRC.abstracts(answers, items.select(F.col("item_id").cast("string").alias("pmid")))


@register("s12_view_states", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN '1.' || CAST(o_orderkey % 3 AS VARCHAR) END AS version, CASE WHEN o_orderkey % 5 > 0 AND o_orderstatus = 'F' THEN 'strong' WHEN o_orderkey % 5 > 0 AND o_orderstatus = 'O' THEN 'all' END AS evidence_filter, CASE WHEN o_orderkey % 5 > 0 THEN 'N' || CAST(o_custkey % 25 AS VARCHAR) || ',' || o_orderpriority END AS pinned FROM orders")
def _view_states(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.to_json(F.struct(F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("1."), (F.col("o_orderkey") % 3).cast("string"))).alias("version"), F.when(F.col("o_orderstatus") == "F", "strong").when(F.col("o_orderstatus") == "O", "all").otherwise("odd").alias("evidenceFilter"), F.array(F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")), "o_orderpriority").alias("pinnedNodes")))
    v = o.select("o_orderkey", SRC.view_state(text).alias("v"))
    return v.select("o_orderkey", F.col("v.version").alias("version"), F.col("v.evidenceFilter").alias("evidence_filter"), F.array_join("v.pinnedNodes", ",").alias("pinned"))


on_trade("s01_s02_validated", "SELECT id FROM edges")(lambda g: (g.validate(), g.update(g.nodes, g.edges).edges.select("id"))[1])
on_trade("s05_x02_graphml_round_trip", "SELECT id, source, target, relation, causal_confidence, strength FROM edges")(lambda g: SRC.parse_graphml(X.as_text(X.graphml(g))).edges.select("id", "source", "target", "relation", "causal_confidence", "strength"))
register("s07_synthetic")(lambda spark, sf: SRC.synthetic(spark, 200).edges.select("id", "source", "target", "relation", "causal_confidence"))
on_trade("x01_node_link")(lambda g: X.node_link(g))
on_trade("x03_gexf")(lambda g: X.as_text(X.gexf(g)))
_CSV = lambda cols: " || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
on_trade("x04_csv_edges", "SELECT 'id,source,target,relation,moduleId,causalConfidence,mechanismDescription,keyInsight,pmid,firstAuthor,year,methodType,notes' AS value UNION ALL SELECT " + _CSV(["id", "source", "target", "relation", "module_id", "causal_confidence", "mechanism_description", "''", "pmid", "first_author", "year", "method_type", "''"]) + " FROM edges")(lambda g: X.csv_edges(g).select("value"))
on_trade("x05_tsv_nodes", "SELECT concat_ws(chr(9), 'id', 'label', 'category', 'subtype', 'moduleId', 'description', 'roles', 'pmid') AS value UNION ALL SELECT concat_ws(chr(9), id, label, category, subtype, module_id, description, role, '') FROM nodes")(lambda g: X.csv_nodes(g, "\t").select("value"))
on_trade("x06_adjacency_cells", "SELECT source, target, CASE relation WHEN 'increases' THEN '+' WHEN 'decreases' THEN '-' WHEN 'inhibits' THEN '-|' ELSE '~' END || causal_confidence AS cell FROM edges")(X.adjacency_cells)
on_trade("x06_adjacency_matrix")(lambda g: X.adjacency_matrix(g, ["R2", "R0"]))
on_trade("x08_report")(lambda g: X.report(D.missing_by_level(g.edges), "citations"))

# ---- beyond the batch operators

register("u01_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda spark, sf: U.type_counts(spark.read.parquet(f"{sf}/events.parquet")))
register("u02_event_flow", G.EVENT_EDGES)(G.event_flow)
