"""Edges that arrive as a stream: upserted by id, with degree and connectivity kept up to date.

An addition to the batch operators: each micro-batch is merged into a table and the
results are derived again from it; late and repeated versions of an edge lose to the one
with the greater version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.basic import first_by


def latest(edges: DataFrame) -> DataFrame:
    """Of each id the row with the greatest version; those marked deleted go."""
    return first_by(edges, ["id"], F.col("version").desc()).where("not deleted")


def maintain(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that appends edges(id, source, target, version, deleted) as versioned files under `folder`.

    A batch that is retried overwrites its own files, so that each counts once.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.select("id", "source", "target", "version", "deleted").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def type_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows, for batches and streams alike; later than `late` is dropped on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
