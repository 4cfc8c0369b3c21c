"""Scalar semantics as Column builders: normalisation, scores, labels, styling, text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..graph import RELATIONS

#: Method -> the synonyms that stand for it, strongest method first.
METHODS = {
    "rct": "rct clinical_trial clinical_trial_failure intervention_human",
    "mendelian_randomization": "mendelian_randomization mr",
    "knockout": "knockout",
    "gwas": "gwas",
    "transgenic": "transgenic",
    "intervention_animal": "intervention_animal animal",
    "imaging": "imaging",
    "in_vitro": "in_vitro intervention_cells biochemistry cryo_em",
    "transcriptomics": "transcriptomics",
    "cohort": "cohort",
    "observational": "observational epidemiological",
    "meta_analysis": "meta_analysis",
    "review": "review expert_opinion",
}
SYNONYMS = {s: m for m, names in METHODS.items() for s in names.split()}
RELATION_FIXES = {"directly_increases": "directlyIncreases", "directly_decreases": "directlyDecreases", "causes_no_change": "causesNoChange", "substrate_of": "substrateof"}
LEGACY_RELATIONS = {"positiveCorrelation": "association", "negativeCorrelation": "association", "noCorrelation": "causesNoChange", "productof": "produces"}
REGULATORS = "Activator IntracellularSensor IonChannel Kinase MasterRegulator NuclearReceptor Phosphatase Protease Pump Repressor SurfaceReceptor Transferase Transporter".split()
TIMESCALES = "seconds minutes hours days weeks months years decades".split()
STOPWORDS = (
    "the a an in of and or to for is are was were be been by at on with from as that this it its has have had not but more less can may "
    "also than both which these those via through into between during leading leads causing causes results resulting including "
    "increased decreased reduced elevated promotes inhibits activates"
).split()


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def normalize_method(raw: Column) -> Column:
    """The strongest known method among the parts of a compound type; null if there is none."""
    known = F.filter(F.transform(F.split(raw, "[,;]"), lambda p: literal_map(SYNONYMS)[F.lower(F.trim(p))]), lambda m: m.isNotNull())
    order = {m: i for i, m in enumerate(METHODS)}
    return F.array_min(F.transform(known, lambda m: F.struct(literal_map(order)[m].alias("rank"), m.alias("name"))))["name"]


def normalize_relation(raw: Column) -> Column:
    return F.when(raw.isin(*RELATIONS), raw).otherwise(F.coalesce(literal_map(RELATION_FIXES)[raw], F.lit("regulates")))


def legacy_relation(raw: Column) -> Column:
    return F.when(raw.isin(*RELATIONS), raw).otherwise(F.coalesce(literal_map(LEGACY_RELATIONS)[raw], F.lit("association")))


def edge_type(explicit: Column, relation: Column, source: Column, target: Column, source_roles: Column, source_subtype: Column, target_category: Column) -> Column:
    """FLOW, TRANSITION, MODULATION or INFLUENCE; an explicit type wins."""
    base = F.split_part(source, F.lit("_"), F.lit(1))
    same = (base == F.split_part(target, F.lit("_"), F.lit(1))) & (F.length(base) > 2)
    regulator = F.coalesce(F.array_contains(source_roles, "REGULATOR"), F.lit(False)) | F.coalesce(source_subtype.isin(*REGULATORS), F.lit(False))
    direct = relation.isin("directlyIncreases", "directlyDecreases") & (target_category == "STATE")
    return F.coalesce(explicit, F.when(relation.isin("substrateof", "productof"), "FLOW").when(same, "TRANSITION").when(regulator | direct, "MODULATION").otherwise("INFLUENCE"))


def timescale_rank(name: Column) -> Column:
    return literal_map({t: i for i, t in enumerate(TIMESCALES, 1)})[name]


def compare_timescales(a: Column, b: Column) -> Column:
    return timescale_rank(a) - timescale_rank(b)


def active_variant(variants: Column, selected: Column, default: Column) -> Column:
    """The variant that is selected, else the default one; null without either."""
    wanted = F.coalesce(selected, default)
    return F.get(F.filter(variants, lambda v: v["id"] == wanted), F.lit(0))


def variant_scale(magnitude: Column) -> Column:
    return F.least(F.lit(4.0), F.greatest(F.lit(0.3), F.sqrt(magnitude)))


def risk_label(magnitude: Column, direction: Column) -> Column:
    good = F.when(magnitude >= 2, "Strong protection").when(magnitude >= 1.5, "Moderate protection").otherwise("Mild protection")
    bad = F.when(magnitude >= 3, "High risk").when(magnitude >= 2, "Moderate risk").when(magnitude >= 1.5, "Elevated risk").otherwise("Slight risk")
    return F.when(direction == "neutral", "No effect").when(direction == "protective", good).otherwise(bad)


def falling(x: Column, full: float, zero: float) -> Column:
    """1 up to `full`, 0 from `zero` on, linear between; null for null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (x - full) / (zero - full))))


def cns_mpo(weight: Column, xlogp: Column, tpsa: Column, hbd: Column, hba: Column, rotatable: Column) -> Column:
    """Six desirabilities of 0 to 1; a missing XLogP counts 0.5."""
    return falling(weight, 360, 500) + F.coalesce(falling(xlogp, 3, 5), F.lit(0.5)) + falling(tpsa, 40, 90) + falling(hbd, 0, 3) + falling(hba, 5, 10) + falling(rotatable, 5, 10)


def bbb_class(score: Column, is_antibody: Column) -> Column:
    return F.when(is_antibody, "none").when(score >= 4, "good").when(score >= 3, "moderate").otherwise("poor")


def edge_color(relation: Column) -> Column:
    low = F.lower(relation)
    green = low.contains("increase") | relation.isin("produces", "catalyzes", "amplifies")
    red = low.contains("decrease") | relation.isin("degrades", "disrupts")
    return F.when(green, "#4ade80").when(red, "#f87171").when(relation == "protects", "#60a5fa").otherwise("#9ca3af")


def level_opacity(level: Column) -> Column:
    """Rises with the level's number; 0.6 for what is no number."""
    n = F.regexp_extract(level, r"^L?([0-9]+)", 1)
    return F.when(n == "", F.lit(0.6)).otherwise(0.3 + F.try_divide(n.cast("double"), F.lit(7)) * 0.7)


def stroke_width(conf_rank: Column) -> Column:
    return F.when(conf_rank <= 1, 2.5).when(conf_rank <= 3, 2.0).when(conf_rank <= 5, 1.5).otherwise(1.0)


def legacy_stroke(conf_rank: Column) -> Column:
    return F.greatest(F.lit(1), 8 - conf_rank)


@pandas_udf(StringType())
def strip_accents(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ"))


def normalize_author(name: Column) -> Column:
    """The first part of a name that is no initial, in lower case without accents."""
    parts = F.split(F.trim(F.regexp_replace(strip_accents(name), r"\.$", "")), r"[\s,]+")

    def full(p: Column) -> Column:
        bare = F.regexp_replace(p, r"[.\-]", "")
        return (F.length(bare) > 2) | (bare != F.upper(bare))

    return F.lower(F.coalesce(F.get(F.filter(parts, full), F.lit(0)), F.get(parts, F.lit(0)), F.lit("")))


def extract_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text.cast("string"), r"([0-9]{4})", 1), F.lit("")).cast("int")


def title_words(t: Column) -> Column:
    """The distinct words of four or more characters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) >= 4))


def title_set_similarity(wa: Column, wb: Column) -> Column:
    """title_similarity of titles whose words were found before, as pairs outnumber titles."""
    least = F.least(F.size(wa), F.size(wb))
    return F.when(wa.isNotNull() & wb.isNotNull() & (least > 0), F.size(F.array_intersect(wa, wb)) / least).otherwise(1.0)


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words of four or more characters over the smaller set; 1 where that can't be said."""
    return title_set_similarity(title_words(a), title_words(b))


def keywords(text: Column, most: int = 8) -> Column:
    """Up to `most` words of three or more characters that are no stopwords, without a final s."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[()\[\]{}\"',;:!?.]", ""), r"[-–—]", " ")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*STOPWORDS))
    return F.slice(F.transform(kept, lambda w: F.regexp_replace(w, "s$", "")), 1, most)


def text_fragment(text: Column, n_words: int = 6) -> Column:
    """The first words, encoded for a link to a passage."""
    return F.concat(F.lit("#:~:text="), F.replace(F.url_encode(F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n_words), " ")), F.lit("+"), F.lit("%20")))


def pubmed_link(pmid: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", ""), r"[\s_-]+"), lambda t: t != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; 0 for two empty ones."""
    return set_overlap(word_set(a), word_set(b))


def set_overlap(x: Column, y: Column) -> Column:
    """word_overlap of texts whose sets were made before, as pairs outnumber texts."""
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def normalize_id(i: Column) -> Column:
    return F.lower(F.replace(i, F.lit("_"), F.lit(" ")))


@pandas_udf(ArrayType(StructType([StructField("type", StringType()), StructField("value", StringType())])))
def chemical_segments(text: pd.Series) -> pd.Series:
    """Runs of normal, sub- and superscript: digits after a letter or bracket sink, a charge after ^ rises."""
    import re

    def one(s: str | None):
        if s is None:
            return None
        out: list[dict] = []
        for m in re.finditer(r"\^\{?([0-9]*[+-]?)\}?|(?<=[A-Za-z)\]])([0-9]+)|([^\^0-9]+|[0-9]+|\^)", s):
            kind, value = ("sup", m[1]) if m[1] else ("sub", m[2]) if m[2] else ("normal", m[3] or "")
            if value:
                out.append({"type": kind, "value": value})
        return out

    return text.map(one)


def node_type(subtype: Column, registry: dict[str, str], default: str) -> Column:
    """A subtype's entry in lower case, else as it is written, else the default."""
    m = literal_map(registry)
    return F.coalesce(m[F.lower(subtype)], m[subtype], F.lit(default))
