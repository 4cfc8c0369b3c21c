"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from causalgraph.llm import containment, linededup, pfair, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go.

    Null and empty texts stay, repeated rows stay or go together, long texts are judged
    whole, an empty table stays empty; see quality.keep_good.
    """
    return quality.keep_good(docs).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur in an earlier document go; so do documents with no line left.

    Null and empty texts stay, the first of equal lines by doc_id (nulls first) and place
    stays, repeated rows lose the same lines; see linededup.bitmaps and apply_bitmaps.
    """
    return linededup.deduplicate_lines(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Texts without a word (null, empty, marks) stay all; of repeated rows one stays; see
    simhash.deduplicate.
    """
    return simhash.deduplicate(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, repeated rows stay or go together, without
    items all stay; see containment.decontaminate.
    """
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its place in the mix.

    No row goes, whatever its text; a null source is a source of its own; repeated rows
    take neighbouring places; an empty table gives no rows; see pfair.mix.
    """
    return pfair.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SimHash groups and the Pfair schedule are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; tables between them lie in the shared folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-pipeline-")
    base = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
