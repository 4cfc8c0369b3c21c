"""Shared helpers of the text operators: tables, tokens, hashing, lineage."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint, shared_folder

WORD = re.compile(r"\w+")

#: Above this many rows a small side is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; [] for null."""
    return WORD.findall(text.lower()) if text else []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The materialised `df`, to be broadcast if it has at most `max_rows` rows."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
