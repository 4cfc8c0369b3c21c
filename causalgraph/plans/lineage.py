"""Where iterative plans cut their lineage: the one place with a checkpoint policy."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that every executor shares (spark.checkpoint.dir).

    Where that is unset a temporary folder serves, which only a single-machine master
    can share.
    """
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="causalgraph-checkpoint-"))
    path = sc._jsc.sc().getCheckpointDir().get()
    return re.sub(r"^(file:)?/+", "file:///", path)


def checkpoint(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
