"""Ranks and running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .lineage import checkpoint


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each in the order (0 for the first).

    Rows are range-partitioned once; the partitions' totals, one row each, give every
    partition its start.  The order should have no ties.
    """
    parts = checkpoint(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.groupBy("__p").agg(F.sum("__v").alias("__t")).select("__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"))
    inner = F.coalesce(F.sum("__v").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("__inner", inner).join(F.broadcast(starts), "__p")
    return rows.withColumn(name, F.col("__start") + F.col("__inner")).drop("__v", "__p", "__inner", "__start")


def rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """`df` with the number of rows before each in the order."""
    return running_total(df, order, F.lit(1).cast("bigint"), name)
