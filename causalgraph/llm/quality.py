"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each rule counts k of n in a text: marks of its characters, repeats of its words, and so
on.  Its value is the end of a confidence interval of k / n that speaks for the text
(three standard errors), so that short texts need no cutoff of their own.  For each rule
a sketch counts values in buckets that grow by a fixed ratio (relative error at most
ALPHA), for each pair of language and source.  Such counts merge by addition, in any
order and with the same result.  Quantiles read from the sketches give each pair its own
fences, which take the place of fixed cutoffs: REACH standard deviations from the median,
as told by the quartile and the 15 % quantile on the fence's side.  A pair's fence is
drawn toward that of its language, and that toward all documents', by PRIOR_DOCS
documents' weight.  Texts are joined with the fences and kept where no value lies beyond.

Scale: texts are read once for the values, which are all that the fences need, and once
to keep the good ones, by an anti join with the rejected texts' hashes: broadcast up to
`common.BROADCAST_ROWS` of them, which are counted first, beyond by a shuffle of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, checkpoint, fresh, small_side, table

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Standard deviations from the median to a fence.
REACH = 4.0
#: Weight of the coarser group's fence in a finer one's, in documents.
PRIOR_DOCS = 50
#: Standard errors between k / n and a value.
ERRORS = 3.0
#: Shares that differ by less are as good as equal.
GRAIN = 0.005
#: Quantile -> standard deviations from the median.
SPREADS = {0.25: 0.6744897501960817, 0.15: 1.0364333894937898}

SYMBOLS = "#$%&*@^~<>\\{}|=+_"
MARKS = "!?;:.,"
BARS = "|\t"
#: Common small words: the to of and in is der die das de des und la le les los que el en et.
STOPS = "t(?:he|o)|of|and|i[ns]|d(?:er|ie|as|es?)|und|l(?:a|es?|os)|que|e[lnt]"

#: Name -> (what is counted, of what, whether much or little of it is bad).
RULES = {
    "symbols": ("symbols", "chars", "high"),
    "capitals": ("capitals", "chars", "high"),
    "marks": ("marks", "chars", "high"),
    "bars": ("bars", "chars", "high"),
    "repeats": ("repeats", "words", "high"),  # words that occurred before
    "lines": ("again", "lines", "high"),  # lines that occurred before
    "long": ("letters", "words", "high"),  # length of words
    "short": ("letters", "words", "low"),
    "stops": ("stops", "words", "low"),  # common small words
    "quiet": ("marks", "chars", "low"),
}


def _value(k: Column, n: Column, rule: str) -> Column:
    """The end of the interval of k / n that speaks for a text."""
    what, _, side = RULES[rule]
    k, n = k.cast("double"), F.greatest(n, F.lit(1)).cast("double")
    error = ERRORS * F.sqrt(2 * k + 1 if what == "letters" else F.greatest(k * (1 - k / n), F.lit(0.0)) + 1)
    return F.greatest((k - error) / n - GRAIN, F.lit(0.0)) if side == "high" else (k + error) / n


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, th, lang, source, <rule>...) of each row; th is a hash of the text, values of null texts are null."""
    text = F.col("text").cast("string")
    n = F.length(text)

    def matches(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(text, pattern, ""))

    words = F.array_remove(F.split(text, r"\s+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    # Two spaces between words, so that neighbours don't share one.
    spaced = F.concat(F.lit(" "), F.lower(F.array_join(words, "  ")), F.lit(" "))
    counts = {
        "chars": n,
        "symbols": matches(f"[{SYMBOLS.replace(chr(92), chr(92) * 2)}]"),
        "marks": matches(f"[{MARKS}]"),
        "bars": matches(f"[{BARS}]"),
        "capitals": matches(r"\p{Lu}"),
        "letters": F.length(F.array_join(words, "")),
        "stops": F.length(F.regexp_replace(spaced, f" ({STOPS}) ", " $1x ")) - F.length(spaced),
        "words": F.size(words),
        "distinct": F.size(F.array_distinct(words)),
        "lines": F.size(lines),
        "once": F.size(F.array_distinct(lines)),
    }
    rows = docs.select(*keep, F.xxhash64(text).alias("th"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.struct(*[c.alias(k) for k, c in counts.items()]).alias("c"))
    c = {k: F.col(f"c.{k}") for k in counts} | {"repeats": F.col("c.words") - F.col("c.distinct"), "again": F.col("c.lines") - F.col("c.once")}
    return rows.select(*keep, "th", "lang", "source", *[F.when(F.col("c.chars").isNotNull(), _value(c[what], c[of], r)).alias(r) for r, (what, of, _) in RULES.items()])


def sketch(featured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketches of each pair; bucket null counts zeros."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("v")
    rows = featured.select("lang", "source", values).where("v.x is not null")
    bucket = F.when(F.col("v.x") > 0, F.ceil(F.ln("v.x") / F.ln(F.lit(GAMMA)))).cast("int")
    return rows.groupBy("lang", "source", F.col("v.rule").alias("rule"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rule, docs, fence) read from sketches."""
    order = W.partitionBy(*by, "rule").orderBy(F.col("bucket").asc_nulls_first())
    total = F.sum("n").over(W.partitionBy(*by, "rule"))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    cum = sketches.withColumns({"cum": F.sum("n").over(order), "total": total, "value": value})
    high = F.col("rule").isin([r for r, (_, _, side) in RULES.items() if side == "high"])

    def at(q: float) -> Column:
        return F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("value")))

    out = cum.groupBy(*by, "rule").agg(F.max("total").alias("docs"), at(0.5).alias("mid"), *[at(q).alias(f"lo{i}") for i, q in enumerate(SPREADS)], *[at(1 - q).alias(f"hi{i}") for i, q in enumerate(SPREADS)])
    up = F.greatest(*[(F.col(f"hi{i}") - F.col("mid")) / z for i, z in enumerate(SPREADS.values())])
    down = F.greatest(*[(F.col("mid") - F.col(f"lo{i}")) / z for i, z in enumerate(SPREADS.values())])
    return out.select(*by, "rule", "docs", F.when(high, F.col("mid") + REACH * up).otherwise(F.col("mid") - REACH * down).alias("fence"))


def thresholds(featured: DataFrame) -> DataFrame:
    """One row for each pair of language and source: (fl, fs, f_<rule>...)."""
    fine = checkpoint(sketch(featured))
    own = fences(fine, ["lang", "source"])
    lang = fences(merge(fine, ["lang"]), ["lang"]).select(F.col("lang").alias("l2"), F.col("rule").alias("r2"), F.col("docs").alias("d2"), F.col("fence").alias("f2"))
    world = fences(merge(fine, []), []).select(F.col("rule").alias("r3"), F.col("fence").alias("f3"))
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2"))).join(world, F.col("rule") == F.col("r3"))
    drawn = (F.col("d2") * F.col("f2") + PRIOR_DOCS * F.col("f3")) / (F.col("d2") + PRIOR_DOCS)
    drawn = (F.col("docs") * F.col("fence") + PRIOR_DOCS * drawn) / (F.col("docs") + PRIOR_DOCS)
    return rows.withColumn("limit", drawn).groupBy(F.col("lang").alias("fl"), F.col("source").alias("fs")).agg(*[F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(f"f_{r}") for r in RULES])


def _judged(featured: DataFrame) -> DataFrame:
    """`featured` with a column `good`."""
    limits = small_side(thresholds(featured), BROADCAST_ROWS // 10)
    joined = featured.join(limits, F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs")), "left")
    good = F.lit(True)
    for r, (_, _, side) in RULES.items():
        # A fence is as exact as its sketch.
        inside = F.col(r) <= F.col(f"f_{r}") * (1 + 2 * ALPHA) if side == "high" else F.col(r) >= F.col(f"f_{r}") * (1 - 2 * ALPHA)
        good = good & F.coalesce(inside, F.lit(True))
    return joined.withColumn("good", good).select(*featured.columns, "good")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns.

    Null texts have no value to judge and stay; empty ones have only values that speak
    for them.  Null languages and sources are groups of their own; repeated rows count
    each and are judged alike; a value that ties with its fence is inside; texts are judged
    whole, whatever their length.  An empty table gives none.
    """
    rejected = _judged(checkpoint(features(docs))).where("not good").select("th", "lang", "source").distinct()
    th, lang, source = fresh(docs, "th", "lang", "source")
    rejected = small_side(rejected.toDF(th, lang, source))
    same = (F.xxhash64(docs["text"].cast("string")) == rejected[th]) & docs["lang"].cast("string").eqNullSafe(rejected[lang]) & docs["source"].cast("string").eqNullSafe(rejected[source])
    return docs.join(rejected, same, "left_anti").select(docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(checkpoint(features(docs, "doc_id").drop("th"))).where("good").drop("good")


def _sql() -> str:
    def value(rule: str) -> str:
        k, of, side = RULES[rule]
        k, n = f"CAST({k} AS DOUBLE)", f"CAST(greatest({of}, 1) AS DOUBLE)"
        error = f"{ERRORS} * sqrt({f'2 * {k} + 1' if RULES[rule][0] == 'letters' else f'greatest({k} * (1 - {k} / {n}), 0.0) + 1'})"
        return f"greatest(({k} - {error}) / {n} - {GRAIN}, 0.0)" if side == "high" else f"({k} + {error}) / {n}"

    def without(chars: str) -> str:
        chars = "'" + chars.replace("\t", "' || chr(9) || '") + "'"
        return f"length(text) - length(translate(text, {chars}, ''))"

    values = ", ".join(f"CASE WHEN text IS NOT NULL THEN {value(r)} END AS {r}" for r in RULES)
    union = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r} AS x FROM f" for r in RULES)
    g = repr(GAMMA)
    high = ", ".join(f"'{r}'" for r, (_, _, side) in RULES.items() if side == "high")

    def level(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        at = lambda q: f"min(value) FILTER (cum >= {q} * total)"
        up = ", ".join(f"({at(1 - q)} - {at(0.5)}) / {z}" for q, z in SPREADS.items())
        down = ", ".join(f"({at(0.5)} - {at(q)}) / {z}" for q, z in SPREADS.items())
        return f"""
{name}_n AS (SELECT {keys}rule, bucket, count(*) AS n FROM b GROUP BY ALL),
{name}_c AS (SELECT *, CASE WHEN bucket IS NULL THEN 0.0 ELSE 2 * pow({g}, bucket) / ({g} + 1) END AS value,
  sum(n) OVER (PARTITION BY {keys}rule ORDER BY bucket NULLS FIRST) AS cum, sum(n) OVER (PARTITION BY {keys}rule) AS total FROM {name}_n),
{name} AS (SELECT {keys}rule, max(total) AS docs, {at(0.5)} + CASE WHEN rule IN ({high}) THEN {REACH} * greatest({up}) ELSE -{REACH} * greatest({down}) END AS fence FROM {name}_c GROUP BY {keys}rule)"""

    beyond = {r: f"f.{r} > t.fence * {1 + 2 * ALPHA}" if side == "high" else f"f.{r} < t.fence * {1 - 2 * ALPHA}" for r, (_, _, side) in RULES.items()}
    limits = " AND ".join(f"NOT EXISTS (SELECT 1 FROM t WHERE t.rule = '{r}' AND t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source AND {x})" for r, x in beyond.items())
    return f"""
WITH r AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l
  FROM documents),
s AS (SELECT *, ' ' || lower(array_to_string(w, '  ')) || ' ' AS spaced FROM r),
c AS (SELECT doc_id, lang, source, text, length(text) AS chars, {without(SYMBOLS)} AS symbols, {without(MARKS)} AS marks, {without(BARS)} AS bars,
  length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS capitals, length(array_to_string(w, '')) AS letters,
  length(regexp_replace(spaced, ' ({STOPS}) ', ' \\1x ', 'g')) - length(spaced) AS stops, len(w) AS words,
  len(w) - len(list_distinct(w)) AS repeats, len(l) AS lines, len(l) - len(list_distinct(l)) AS again FROM s),
f AS (SELECT doc_id, lang, source, {values} FROM c),
v AS ({union}),
b AS (SELECT lang, source, rule, CASE WHEN x > 0 THEN ceil(ln(x) / ln({g})) END AS bucket FROM v WHERE x IS NOT NULL),
{level("own", "lang, source")}, {level("lng", "lang")}, {level("world", "")},
t AS (SELECT own.lang, own.source, own.rule,
  (own.docs * own.fence + {PRIOR_DOCS} * ((lng.docs * lng.fence + {PRIOR_DOCS} * world.fence) / (lng.docs + {PRIOR_DOCS}))) / (own.docs + {PRIOR_DOCS}) AS fence
  FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.rule = lng.rule JOIN world ON own.rule = world.rule)
SELECT doc_id, lang, source, {", ".join(RULES)} FROM f WHERE {limits}
"""


SQL = _sql()
