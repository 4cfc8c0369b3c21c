"""Treatments, presets and biomarkers: queries over nested catalog tables.

treatments(id, name, type, fda_status, evidence_level, primary_targets array<struct<node_id, effect, strength>>, ord)
presets(id, category, treatment_ids array, node_ids array, hypothesis boolean, ord)
biomarkers(node_id, years_before_symptoms, method, atn, commercial_status, ord)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CausalGraph
from .traversal import view_pathway


def treatments_by(t: DataFrame, **equal: str) -> DataFrame:
    for col, value in equal.items():
        t = t.where(F.col(col) == value)
    return t


def targeting(t: DataFrame, node_id: str, effects: list[str] | None = None) -> DataFrame:
    """Treatments with a target at the node (of one of the effects)."""
    return t.where(F.exists("primary_targets", lambda x: (x["node_id"] == node_id) & (x["effect"].isin(*effects) if effects else F.lit(True))))


def inhibitors(t: DataFrame, node_id: str) -> DataFrame:
    return targeting(t, node_id, ["inhibits", "decreases"])


def activators(t: DataFrame, node_id: str) -> DataFrame:
    return targeting(t, node_id, ["activates", "increases"])


def target_nodes(t: DataFrame) -> DataFrame:
    return t.select(F.explode("primary_targets.node_id").alias("node_id")).distinct()


def preset(p: DataFrame, preset_id: str) -> DataFrame:
    return p.where(F.col("id") == preset_id).orderBy("ord").limit(1)


def presets_by_category(p: DataFrame, category: str) -> DataFrame:
    return p.where(F.col("category") == category).orderBy("ord")


def treatments_of_preset(p: DataFrame, t: DataFrame, preset_id: str) -> DataFrame:
    """The preset's treatments in its order; ids without a record drop out."""
    ids = preset(p, preset_id).select(F.posexplode("treatment_ids").alias("pos", "tid"))
    return ids.join(t, F.col("tid") == F.col("id")).orderBy("pos").drop("pos", "tid")


def modules_of_preset(g: CausalGraph, p: DataFrame, preset_id: str) -> DataFrame:
    ids = preset(p, preset_id).select(F.explode("node_ids").alias("n"))
    return g.nodes.join(ids, F.col("id") == F.col("n"), "left_semi").select("module_id").distinct()


def select_preset(g: CausalGraph, p: DataFrame, t: DataFrame, preset_id: str, depth: int = 3) -> DataFrame:
    """(id): the pathway of the only treatment, or the targets of several."""
    own = treatments_of_preset(p, t, preset_id)
    targets = [r.node_id for r in target_nodes(own).collect()]  # as many as a preset names
    if own.count() != 1:
        return g.nodes.sparkSession.createDataFrame([(x,) for x in sorted(targets)], "id string")
    path = view_pathway(g, targets, depth)
    return path["targets"].union(path["upstream"]).union(path["downstream"]).distinct()


def pathway_counts(path: dict[str, DataFrame]) -> DataFrame:
    """(part, n) of a pathway's targets, upstream, downstream and modules."""
    out = None
    for part in ("targets", "upstream", "downstream", "modules"):
        row = path[part].agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def biomarker_timeline(b: DataFrame) -> DataFrame:
    return b.orderBy(F.col("years_before_symptoms").desc(), "ord")


def biomarkers_by(b: DataFrame, **equal: str) -> DataFrame:
    return treatments_by(b, **equal).orderBy("ord")


def detectable(b: DataFrame, years: int) -> DataFrame:
    """Those that show at least so many years before symptoms."""
    return b.where(F.col("years_before_symptoms") >= years).orderBy(F.col("years_before_symptoms").desc(), "ord")


def dose_effect(t: DataFrame) -> DataFrame:
    """(id, variant, multiplier) of treatments with variants array<struct<name, multiplier>>."""
    return t.select("id", F.explode("variants").alias("v")).select("id", F.col("v.name").alias("variant"), F.col("v.multiplier").alias("multiplier"))
