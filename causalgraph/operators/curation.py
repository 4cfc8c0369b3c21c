"""Audits, citation checks, repair, metrics; identifier maps, translation, integration, comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from ..functions.confidence import Scheme
from ..graph import CausalGraph
from ..plans.rank import rank
from .basic import first_by


def missing(c: Column) -> Column:
    """Null, empty and zero count as missing."""
    return c.isNull() | c.cast("string").isin("", "0")


# ---- audits


def audit(g: CausalGraph) -> DataFrame:
    """(issue, id) of duplicate ids, unknown modules, broken ends, orphans, self-loops."""
    ids = g.nodes.select(F.col("id").alias("__i"))
    dup = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("issue"), "id")
    parts = [dup(g.nodes, "duplicate_node"), dup(g.edges, "duplicate_edge")]
    if g.modules is not None:
        parts.append(g.nodes.join(g.modules.select(F.col("id").alias("__m")), F.col("module_id") == F.col("__m"), "left_anti").select(F.lit("unknown_module").alias("issue"), "id"))
    parts.append(g.edges.join(ids, F.col("source") == F.col("__i"), "left_anti").select(F.lit("broken_source").alias("issue"), "id"))
    parts.append(g.edges.join(ids, F.col("target") == F.col("__i"), "left_anti").select(F.lit("broken_target").alias("issue"), "id"))
    ends = g.edges.select(F.col("source").alias("e")).union(g.edges.select("target"))
    parts.append(g.nodes.join(ends, F.col("id") == F.col("e"), "left_anti").select(F.lit("orphan").alias("issue"), "id"))
    parts.append(g.edges.where("source = target").select(F.lit("self_loop").alias("issue"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_incoming(g: CausalGraph) -> DataFrame:
    return g.nodes.join(g.edges.select(F.col("target").alias("t")), F.col("id") == F.col("t"), "left_anti").select("id", "module_id")


def citation_coverage(edges: DataFrame) -> DataFrame:
    """One row: edges, and how many have each citation field, all of them, and none."""
    have = {c: ~missing(F.col(c)) for c in ("pmid", "first_author", "year", "mechanism_description", "method_type")}
    full = have["pmid"] & have["first_author"] & have["year"] & have["method_type"]
    return edges.agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(c).alias(f"with_{n}") for n, c in have.items()], F.count_if(full).alias("fully_cited"))


def missing_by_level(edges: DataFrame) -> DataFrame:
    return edges.groupBy("causal_confidence").agg(F.count(F.lit(1)).alias("edges"), F.count_if(missing(F.col("pmid"))).alias("without_pmid"))


def method_survey(edges: DataFrame) -> DataFrame:
    """Methods by level, wide: one column a level."""
    return edges.groupBy(F.coalesce("method_type", F.lit("")).alias("method")).pivot("causal_confidence", ["L1", "L2", "L3", "L4", "L5", "L6", "L7"]).count().na.fill(0)


def case_variants(edges: DataFrame) -> DataFrame:
    """(method, spellings) of methods written in more than one way."""
    return edges.where("method_type is not null").groupBy(F.lower("method_type").alias("method")).agg(F.array_sort(F.collect_set("method_type")).alias("s")).where(F.size("s") > 1).select("method", F.array_join("s", ",").alias("spellings"))


def scheme_mismatches(edges: DataFrame, scheme: Scheme) -> DataFrame:
    """Edges whose level is not that of their method under the scheme."""
    want = scheme.classify(F.col("method_type"), F.col("pmid"), F.col("causal_confidence"))
    return edges.where(F.col("method_type").isNotNull()).withColumn("expected", want).where("expected <> causal_confidence").select("id", "method_type", "causal_confidence", "expected")


def verified_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("causal_confidence", "relation").agg(F.count(F.lit(1)).alias("edges"), F.count_if(~missing(F.col("pmid"))).alias("with_pmid"))


# ---- citations


def compare_sources(edges: DataFrame, pubmed: DataFrame, crossref: DataFrame) -> DataFrame:
    """(id, issues, warnings) of edges with a known pmid against pubmed(pmid, title, first_author, year) and crossref(pmid, title, year).

    Errors: another author or a year more than one off; titles that share under 0.4; a
    year gap over one between the two sources is a warning.
    """
    p = pubmed.select(F.col("pmid").alias("pp"), F.col("first_author").alias("pa"), F.col("year").alias("py"), F.col("title").alias("pt"))
    c = crossref.select(F.col("pmid").alias("cp"), F.col("year").alias("cy"), F.col("title").alias("ct"))
    rows = edges.join(p, F.col("pmid") == F.col("pp")).join(c, F.col("pmid") == F.col("cp"), "left")
    author = ~missing(F.col("first_author")) & (S.normalize_author(F.col("first_author")) != S.normalize_author(F.col("pa")))
    year = ~missing(F.col("year")) & (F.abs(F.col("year") - F.col("py")) > 1)
    title = S.title_similarity(F.col("pt"), F.col("ct")) < 0.4
    gap = F.abs(F.col("py") - F.col("cy")) > 1
    issues = F.array_compact(F.array(F.when(author, "author"), F.when(year, "year"), F.when(title, "title")))
    return rows.select("id", F.array_join(issues, ",").alias("issues"), F.when(gap, "year_gap").otherwise("").alias("warnings"))


def enrich(edges: DataFrame, pubmed: DataFrame) -> DataFrame:
    """Edges with missing author and year filled in from pubmed(pmid, first_author, year)."""
    p = pubmed.select(F.col("pmid").alias("pp"), F.col("first_author").alias("pa"), F.col("year").alias("py"))
    rows = edges.join(p, F.col("pmid") == F.col("pp"), "left")
    fill = lambda c, by: F.when(missing(F.col(c)), F.coalesce(by, c)).otherwise(F.col(c))
    return rows.withColumns({"first_author": fill("first_author", "pa"), "year": fill("year", "py")}).drop("pp", "pa", "py")


def repair_candidates(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, pmid, score, tier): the best candidate of each citation.

    wanted(id, title, author, year), candidates(id, ord, pmid, title, author, year): title
    similarity + 0.2 for the year + 0.3 for the author; from 0.3 on, the first of equals.
    """
    w = wanted.toDF("id", "wt", "wa", "wy")
    rows = w.join(candidates, "id")
    score = S.title_similarity(F.col("wt"), F.col("title")) + F.when(F.abs(F.col("wy") - F.col("year")) <= 0, 0.2).otherwise(0.0) + F.when(S.normalize_author(F.col("wa")) == S.normalize_author(F.col("author")), 0.3).otherwise(0.0)
    rows = rows.select("id", "ord", "pmid", F.round(score, 9).alias("score")).where("score >= 0.3")
    best = first_by(rows, ["id"], F.col("score").desc(), "ord")
    return best.select("id", "pmid", "score", F.when(F.col("score") >= 1, "HIGH").when(F.col("score") >= 0.6, "MEDIUM").otherwise("LOW").alias("tier"))


def metrics(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, n, least, most, mean, median, p25, p75) of values(*by, value); quartiles are the values of rank floor(n p).

    Ranks come from one range partitioning by group and value, so that a large group is
    spread over many tasks; exact, without collecting values.
    """
    by = by or []
    rows = rank(values.where("value is not null").select(*by, "value"), [*by, "value"], "g")
    groups = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("size"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    ranked = rows.join(groups, same) if by else rows.crossJoin(F.broadcast(groups))
    ranked = ranked.withColumn("r", F.col("g") - F.col("first"))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("value")))
    n = F.col("size")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), middle.alias("median"), at(F.floor(n * 0.25)).alias("p25"), at(F.floor(n * 0.75)).alias("p75"))


def most_cited(values: DataFrame, n: int = 10) -> DataFrame:
    """(place, id, value): the n largest of values(id, value), equals by id; nulls don't count. Each task keeps n rows."""
    best = values.where("value is not null").select("id", "value").orderBy(F.col("value").desc(), "id").limit(n)
    return best.select(F.row_number().over(W.orderBy(F.col("value").desc(), "id")).alias("place"), "id", "value")


def tier(percentile: Column) -> Column:
    return F.when(percentile >= 90, "landmark").when(percentile >= 75, "high").when(percentile >= 50, "solid").when(percentile >= 25, "modest").otherwise("low")


def verdict_tally(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(verdict, n); claims without a verdict are pending."""
    v = verdicts.select(F.col("id").alias("v_id"), "verdict")
    return claims.join(v, F.col("id") == F.col("v_id"), "left").groupBy(F.coalesce("verdict", F.lit("pending")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def patch_pmids(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """Edges with pmid replaced where patches(id, old_pmid, new_pmid) name the value they have."""
    p = patches.select(F.col("id").alias("p_id"), "old_pmid", "new_pmid")
    hit = (F.col("id") == F.col("p_id")) & (F.col("pmid") == F.col("old_pmid"))
    return edges.join(p, hit, "left").withColumn("pmid", F.coalesce("new_pmid", "pmid")).drop("p_id", "old_pmid", "new_pmid")


def supporting_sentence(claims: DataFrame) -> DataFrame:
    """(id, sentence, score) for claims(id, claim, abstract): the first sentence with most of the claim's words of over four characters."""
    terms = F.array_distinct(F.filter(F.split(F.lower("claim"), r"\s+"), lambda w: F.length(w) > 4))
    rows = claims.select("id", terms.alias("terms"), F.posexplode(F.split("abstract", r"\. ")).alias("pos", "sentence"))
    score = F.size(F.filter("terms", lambda w: F.lower("sentence").contains(w)))
    rows = rows.withColumn("score", score)
    return first_by(rows, ["id"], F.col("score").desc(), "pos").select("id", "sentence", "score")


def cache_key(claims: Column, abstract: Column) -> Column:
    return F.sha2(F.concat(F.array_join(claims, "\n"), abstract), 256)


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open): requests(id, claims, abstract) whose key is in cache(key, verdict), and the rest."""
    keyed = requests.withColumn("key", cache_key(F.col("claims"), F.col("abstract")))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


# ---- reconciliation


def map_ids(old: DataFrame, new: DataFrame, fuzzy: float = 0.8, bonus: float = 0.05, bonus_from: float = 0.7) -> DataFrame:
    """(old_id, new_id, match): exact ids, then labels without case (own module first), then greedy word overlap, one to one.

    old and new have id, label, module_id, ord.  The last pass compares what is left in
    one task, in input order, as each choice depends on those before it; pairs that share
    no word never meet.
    """
    o = old.select(F.col("id").alias("oid"), F.col("label").alias("ol"), F.col("module_id").alias("om"), F.col("ord").alias("oo"))
    n = new.select(F.col("id").alias("nid"), F.col("label").alias("nl"), F.col("module_id").alias("nm"), F.col("ord").alias("no"))
    exact = o.join(n, F.col("oid") == F.col("nid")).select("oid", "nid", F.lit("exact").alias("match"))
    o2, n2 = o.join(exact.select("oid"), "oid", "left_anti"), n.join(exact.select("nid"), "nid", "left_anti")
    same = o2.join(n2, F.lower("ol") == F.lower("nl"))
    own = F.col("om") == F.col("nm")
    # Equal labels pair off in order within their module, then across modules.
    first = first_by(first_by(same, ["oid"], own.desc(), "no"), ["nid"], own.desc(), "oo")
    label = first.select("oid", "nid", F.lit("label").alias("match"))
    o3, n3 = o2.join(label.select("oid"), "oid", "left_anti"), n2.join(label.select("nid"), "nid", "left_anti")
    ot = o3.select("oid", "om", "oo", S.word_set(F.col("ol")).alias("x")).withColumn("t", F.explode("x"))
    nt = n3.select("nid", "nm", "no", S.word_set(F.col("nl")).alias("y")).withColumn("t", F.explode("y"))
    met = ot.join(nt, "t").select("oid", "om", "oo", "x", "nid", "nm", "no", "y").distinct()
    base = S.set_overlap(F.col("x"), F.col("y"))
    score = base + F.when((F.col("om") == F.col("nm")) & (base >= bonus_from), bonus).otherwise(0.0)
    met = met.select("oid", "oo", "nid", "no", F.round(score, 9).alias("score")).where(F.col("score") >= fuzzy).withColumn("one", F.lit(1))

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for oid, block in part.sort_values(["oo", "score", "no"], ascending=[True, False, True]).groupby("oid", sort=False):
            for nid in block["nid"]:
                if nid not in used:
                    used.add(nid)
                    rows.append((oid, nid, "fuzzy"))
                    break
        return pd.DataFrame(rows, columns=["oid", "nid", "match"])

    found = met.groupBy("one").applyInPandas(greedy, "oid string, nid string, match string")
    return exact.unionByName(label).unionByName(found).toDF("old_id", "new_id", "match")


def map_ids_stepwise(old: DataFrame, new: DataFrame, manual: DataFrame) -> DataFrame:
    """(old_id, new_id, match_type) by id, id without case, label, id without underscores, hand-made list; the first that hits."""
    o = old.select(F.col("id").alias("old_id"), F.col("label").alias("ol"))
    keys = [("exact", F.col("old_id"), F.col("id")), ("case_insensitive", F.lower("old_id"), F.lower("id")), ("label", F.lower("ol"), F.lower("label")), ("stripped", F.lower(F.replace("old_id", F.lit("_"))), F.lower(F.replace("id", F.lit("_"))))]
    rows = o
    for k, (_, left, right) in enumerate(keys):
        n = new.groupBy(right.alias(f"k{k}")).agg(F.min("id").alias(f"n{k}"))
        rows = rows.join(n, left == F.col(f"k{k}"), "left")
    m = manual.select(F.col("old_id").alias("m_old"), F.col("new_id").alias("n4"))
    rows = rows.join(m, F.col("old_id") == F.col("m_old"), "left")
    kind = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate([*(x[0] for x in keys), "manual"]))):
        kind = F.when(F.col(f"n{k}").isNotNull(), name).otherwise(kind)
    return rows.select("old_id", F.coalesce(*[F.col(f"n{k}") for k in range(5)]).alias("new_id"), kind.alias("match_type"))


def translate_edges(old: DataFrame, id_map: DataFrame, current: DataFrame) -> DataFrame:
    """(id, source, target, status) of old edges under an id map: unmapped, self, citation_only, duplicate or new_edge.

    citation_only: the pair is there without a pmid and the old edge has one; of old
    edges that come to the same pair the first by ord is new.
    """
    m = id_map.select("old_id", "new_id")
    rows = old.select("id", F.col("source").alias("os"), F.col("target").alias("ot"), "pmid", "ord")
    rows = rows.join(m.toDF("os", "source"), "os", "left").join(m.toDF("ot", "target"), "ot", "left")
    have = current.groupBy(F.col("source").alias("hs"), F.col("target").alias("ht")).agg(F.max(~missing(F.col("pmid"))).alias("cited"))
    rows = rows.join(have, (F.col("source") == F.col("hs")) & (F.col("target") == F.col("ht")), "left")
    rank = F.row_number().over(W.partitionBy("source", "target").orderBy("ord"))
    status = (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "unmapped").when(F.col("source") == F.col("target"), "self")
        .when(F.col("hs").isNotNull() & ~F.col("cited") & ~missing(F.col("pmid")), "citation_only").when(F.col("hs").isNotNull() | (rank > 1), "duplicate").otherwise("new_edge")
    )
    return rows.select("id", "source", "target", status.alias("status"))


def apply_recovered(current: DataFrame, recovered: DataFrame) -> DataFrame:
    """Current edges with missing citations filled in, and new ones; an id that is taken becomes REC.nnn.

    Both have id, source, target, relation, pmid, first_author, year, ord.
    """
    cols = ["id", "source", "target", "relation", "pmid", "first_author", "year"]
    r = recovered.select(*[F.col(c).alias(f"r_{c}") for c in cols], F.col("ord").alias("r_ord"))
    first = first_by(r, ["r_source", "r_target"], "r_ord")
    rows = current.join(first, (F.col("source") == F.col("r_source")) & (F.col("target") == F.col("r_target")), "left")
    kept = rows.select("id", "source", "target", "relation", *[F.when(missing(F.col(c)), F.coalesce(f"r_{c}", c)).otherwise(F.col(c)).alias(c) for c in cols[4:]])
    new = first.join(current.select(F.col("source").alias("s"), F.col("target").alias("t")), (F.col("r_source") == F.col("s")) & (F.col("r_target") == F.col("t")), "left_anti")
    taken = new.join(current.select(F.col("id").alias("c_id")), F.col("r_id") == F.col("c_id"), "left")
    number = F.row_number().over(W.partitionBy(F.col("c_id").isNotNull()).orderBy("r_ord"))
    name = F.when(F.col("c_id").isNotNull(), F.concat(F.lit("REC."), F.lpad(number.cast("string"), 3, "0"))).otherwise(F.col("r_id"))
    added = taken.select(name.alias("id"), F.col("r_source").alias("source"), F.col("r_target").alias("target"), S.legacy_relation(F.col("r_relation")).alias("relation"), *[F.col(f"r_{c}").alias(c) for c in cols[4:]])
    return kept.unionByName(added)


def integrate_verified(verified: DataFrame, nodes: DataFrame, current: DataFrame, start: int = 1) -> DataFrame:
    """(id, source, target, relation, method_type, causal_confidence) of supported candidates.

    verified(ord, source, target, supported, direction, relation, method_type, confidence):
    reverse flips, bidirectional gives both; unknown ends and pairs that are there drop
    out; ids are V and four digits; a level gives way to a method.
    """
    one = lambda a, b: F.struct(F.col(a).alias("s"), F.col(b).alias("t"))
    ways = F.when(F.col("direction") == "reverse", F.array(one("target", "source"))).when(F.col("direction") == "bidirectional", F.array(one("source", "target"), one("target", "source"))).otherwise(F.array(one("source", "target")))
    rows = verified.where("supported").select("ord", F.posexplode(ways).alias("k", "e"), "relation", "method_type", "confidence").select("ord", "k", "e.*", "relation", "method_type", "confidence")
    ids = nodes.select(F.col("id").alias("i"))
    rows = rows.join(ids, F.col("s") == F.col("i"), "left_semi").join(ids, F.col("t") == F.col("i"), "left_semi")
    rows = rows.join(current.select(F.col("source").alias("cs"), F.col("target").alias("ct")), (F.col("s") == F.col("cs")) & (F.col("t") == F.col("ct")), "left_anti")
    rows = first_by(rows, ["s", "t"], "ord", "k")
    rows = rank(rows, ["ord", "k"], "before")
    number = F.col("before") + start
    method = S.normalize_method(F.col("method_type"))
    return rows.select(F.concat(F.lit("V"), F.lpad(number.cast("string"), 4, "0")).alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), S.normalize_relation(F.col("relation")).alias("relation"), method.alias("method_type"), F.when(method.isNull(), F.col("confidence")).alias("causal_confidence"))


def append_missing(sheet: DataFrame, rows: DataFrame) -> DataFrame:
    """The sheet and the rows whose id it lacks."""
    return sheet.unionByName(rows.join(sheet.select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_anti"), allowMissingColumns=True)


def compare(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """(<by>, n_old, n_new, shared, delta): a full outer join of counts by group."""
    a = old.groupBy(F.col(by).alias("ka")).agg(F.count(F.lit(1)).alias("n_old"))
    b = new.groupBy(F.col(by).alias("kb")).agg(F.count(F.lit(1)).alias("n_new"))
    both = old.select("id", by).intersect(new.select("id", by)).groupBy(F.col(by).alias("kc")).agg(F.count(F.lit(1)).alias("shared"))
    rows = a.join(b, F.col("ka").eqNullSafe(F.col("kb")), "full").join(both, F.coalesce("ka", "kb").eqNullSafe(F.col("kc")), "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(F.coalesce("ka", "kb").alias(by), z("n_old").alias("n_old"), z("n_new").alias("n_new"), z("shared").alias("shared"), (z("n_new") - z("n_old")).alias("delta"))


def compare_graphs(old: CausalGraph, new: CausalGraph) -> DataFrame:
    """(kind, n_old, n_new, shared, only_old, only_new) for nodes and edges by id and for distinct (source, target) pairs.

    Both sides meet in one aggregation a kind, which combines before its shuffle; a null id is one value.
    """
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))

    def kind(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumns({"o": F.lit(1), "n": F.lit(0)}).unionByName(b.withColumns({"o": F.lit(0), "n": F.lit(1)}))
        rows = both.groupBy(*a.columns).agg(F.max("o").alias("o"), F.max("n").alias("n"))
        o, n = F.col("o"), F.col("n")
        return rows.agg(z(o).alias("n_old"), z(n).alias("n_new"), z(o * n).alias("shared"), z(o * (1 - n)).alias("only_old"), z(n * (1 - o)).alias("only_new")).select(F.lit(name).alias("kind"), "*")

    ends = lambda g: g.edges.select("source", "target")
    ids = lambda df: df.select("id")
    return kind("nodes", ids(old.nodes), ids(new.nodes)).unionByName(kind("edges", ids(old.edges), ids(new.edges))).unionByName(kind("pairs", ends(old), ends(new)))


def summary(g: CausalGraph) -> DataFrame:
    """One row (nodes, edges, orphans, orphan_pct, edges_per_node, cited, cited_pct); shares are null where there is nothing to share."""
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("e")).distinct()
    nodes = g.nodes.join(ends, F.col("id") == F.col("e"), "left").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("e").isNull()).alias("orphans"))
    edges = g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.coalesce("pmid", F.lit("")) != "").alias("cited"))
    share = lambda a, b: F.try_divide(F.lit(100.0) * F.col(a), F.col(b))
    # Each side is one row.
    return nodes.crossJoin(edges).select("nodes", "edges", "orphans", F.round(share("orphans", "nodes"), 1).alias("orphan_pct"), F.round(F.try_divide(F.col("edges").cast("double"), "nodes"), 2).alias("edges_per_node"), "cited", F.round(share("cited", "edges"), 1).alias("cited_pct"))


def candidate_pairs(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """(a, b): distinct unordered pairs of candidates(source, target) that no edge joins in either direction."""
    pair = lambda df: df.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    return pair(candidates).join(pair(current), ["a", "b"], "left_anti")


def next_batch(items: DataFrame, processed: DataFrame, size: int) -> DataFrame:
    """The first `size` items by ord that are not in processed(id)."""
    return items.join(processed.select(F.col("id").alias("p")), F.col("id") == F.col("p"), "left_anti").orderBy("ord").limit(size)


def delete_row(df: DataFrame, row_id: str) -> DataFrame:
    return df.where(F.col("id") != row_id)
