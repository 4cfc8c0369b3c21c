"""Evidence levels, weights and classification schemes, compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("L1", "L2", "L3", "L4", "L5", "L6", "L7")
DEFAULT_WEIGHTS = dict(zip(LEVELS, (1.0, 0.85, 0.7, 0.55, 0.4, 0.3, 0.2)))
INHIBITORY = ("decreases", "directlyDecreases", "degrades", "traps", "disrupts", "inhibits")
CUTOFFS = {"strong": 3, "moderate": 5, "all": 7}


def rank(level: Column) -> Column:
    """1 (strongest) to 7; null for what is no level."""
    return F.when(level.rlike("^L[1-7]$"), F.substring(level, 2, 1).cast("int"))


def _lookup(mapping: dict[str, object], key: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(None) if out is None else out


def strength(level: Column, weights: dict[str, float] | None = None) -> Column:
    """The level's weight; custom weights win where given."""
    if weights and any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    return _lookup(DEFAULT_WEIGHTS | (weights or {}), level).cast("double")


def distance(level: Column, weights: dict[str, float] | None = None) -> Column:
    """1 / strength; infinite for strength 0."""
    s = strength(level, weights)
    return F.when(s == 0, F.lit(float("inf"))).otherwise(1 / s)


def is_inhibitory(relation: Column) -> Column:
    return relation.isin(*INHIBITORY)


@dataclass(frozen=True)
class Rule:
    level: str
    methods: Sequence[str] = ()
    requires_pmid: bool | None = None
    min_existing: str | None = None


@dataclass(frozen=True)
class Scheme:
    """Ordered rules; the first that matches an edge gives its level."""

    name: str
    rules: Sequence[Rule]
    default: str = "L7"
    cutoffs: dict = field(default_factory=dict)

    def classify(self, method: Column, pmid: Column, existing: Column) -> Column:
        lowered = F.lower(F.coalesce(method, F.lit("")))
        out = None
        for rule in self.rules:
            hit = F.lit(True)
            if rule.methods:
                hit = hit & lowered.isin(*[m.lower() for m in rule.methods])
            if rule.requires_pmid is not None:
                hit = hit & (pmid.isNotNull() if rule.requires_pmid else pmid.isNull())
            if rule.min_existing is not None:
                hit = hit & F.coalesce(rank(existing) <= int(rule.min_existing[1]), F.lit(False))
            out = F.when(hit, rule.level) if out is None else out.when(hit, rule.level)
        return F.lit(self.default) if out is None else out.otherwise(self.default)

    def effective(self, method: Column, evidence_method: Column, existing: Column) -> Column:
        """The reading of a view: an existing level wins, then the method's last rule, then the default."""
        levels: dict[str, object] = {}
        for rule in self.rules:
            for m in rule.methods:
                levels[m.lower()] = rule.level
        own = F.lower(F.coalesce(method, evidence_method, F.lit("")))
        return F.coalesce(F.nullif(existing, F.lit("")), _lookup(levels, own), F.lit(self.default))


def _named(name: str, *rows: tuple[str, str]) -> Scheme:
    return Scheme(name, [Rule(level, methods.split()) for level, methods in rows])


ENGINE_DEFAULT = _named(
    "engine_default",
    ("L1", "clinical_trial rct"),
    ("L2", "mr mendelian_randomization natural_experiment"),
    ("L3", "gwas knockout transgenic"),
    ("L4", "animal epidemiological imaging intervention_animal"),
    ("L5", "biochemistry cryo_em in_vitro intervention_cells transcriptomics"),
    ("L6", "cohort meta_analysis observational"),
    ("L7", "expert_opinion review"),
)
UI_DEFAULT = _named(
    "ui_default",
    ("L1", "rct"), ("L2", "mendelian_randomization"), ("L3", "gwas knockout transgenic"), ("L4", "imaging intervention_animal"),
    ("L5", "in_vitro transcriptomics"), ("L6", "cohort meta_analysis observational"), ("L7", "review"),
)
AUDIT_MAP = _named(
    "audit_map",
    ("L1", "clinical_trial clinical_trial_failure rct"),
    ("L2", "mr mendelian_randomization"),
    ("L3", "gwas knockout transgenic"),
    ("L4", "animal epidemiological imaging intervention_animal intervention_human"),
    ("L5", "biochemistry cryo_em in_vitro intervention_cells transcriptomics"),
    ("L6", "cohort meta_analysis observational"),
    ("L7", "expert_opinion review"),
)
SCHEMES = {s.name: s for s in (ENGINE_DEFAULT, UI_DEFAULT, AUDIT_MAP)}


def weigh(edges: DataFrame, weights: dict[str, float] | None = None, scheme: Scheme | None = None) -> DataFrame:
    """Edges with level (classified anew under a scheme), conf_rank, strength, distance and is_inhibitory.

    Weights in the input are never trusted; a missing or unknown level counts as L7.
    """
    level = F.col("causal_confidence")
    if scheme is not None:
        level = scheme.classify(F.col("method_type"), F.col("pmid"), level)
    level = F.when(rank(level).isNotNull(), level).otherwise("L7")
    out = edges.withColumn("causal_confidence", level)
    own = F.col("causal_confidence")
    return out.withColumns({"conf_rank": rank(own), "strength": strength(own, weights), "distance": distance(own, weights), "is_inhibitory": is_inhibitory(F.col("relation"))})


def overlay(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Strength times the magnitude selected for an edge's source in selection(node_id, magnitude); transient."""
    joined = edges.join(selection.select(F.col("node_id").alias("__n"), "magnitude"), F.col("source") == F.col("__n"), "left")
    return joined.withColumn("strength", F.col("strength") * F.coalesce("magnitude", F.lit(1.0))).drop("__n", "magnitude")
