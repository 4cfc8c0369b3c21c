"""Exact line de-duplication that returns bitmaps of what to keep.

Hashes of lines are range-partitioned and sorted by (hash, document, position); a
streaming window keeps the first of each run.  What comes back is not text but one
run-length coded bitmap for each document: "3,1,4" keeps three lines, drops one and
keeps four; the code starts with a kept run, "0,2" drops both lines.

Scale: only 16-byte hashes and positions are shuffled, and of lines that a task meets
often no more than its own first occurrence competes with other tasks': a line that
millions of documents share costs a row a task, not a row an occurrence.  Blank lines,
which are always kept, are not shuffled by hash at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, checkpoint, table

#: Lines that a task combines at once.
COMBINE = 200_000
#: Bitmaps of more characters in all are joined by shuffle.
BROADCAST_CHARS = 64_000_000
KEY = ["h1", "h2", "doc_id", "th", "pos"]


def _ids(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lines) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.split(F.col("text").cast("string"), "\n").alias("lines"))


def _lines(docs: DataFrame) -> DataFrame:
    """KEY of each line of each row that isn't blank; pos from 0."""
    rows = _ids(docs).select("doc_id", "th", F.posexplode("lines").alias("pos", "line")).where(F.trim("line") != "")
    return rows.select(F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), "doc_id", "th", "pos")


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each line the first occurrence among those that come together."""

    def combine(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        doc = rows.column("doc_id")
        keys = [rows.column("pos").to_numpy(), rows.column("th").to_numpy(), pc.fill_null(doc, 0).to_numpy(), pc.is_valid(doc).to_numpy(), rows.column("h2").to_numpy(), rows.column("h1").to_numpy()]
        order = np.lexsort(keys)
        h1, h2 = keys[5][order], keys[4][order]
        first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        yield from rows.take(pa.array(order[first])).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= COMBINE:
            yield from combine(held)
            held = []
    if held:
        yield from combine(held)


def first_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos) of the first occurrence of each line that isn't blank.

    The order of documents is that of doc_id (nulls first), then of the hash of the
    text.  The two hashes make 128 bits, so that no two lines of any corpus share them.
    """
    lines = _lines(docs).mapInArrow(_least, "h1 long, h2 long, doc_id long, th long, pos int")
    lines = lines.repartitionByRange("h1", "h2").sortWithinPartitions(*KEY)
    order = W.partitionBy("h1", "h2").orderBy("doc_id", "th", "pos")
    return lines.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "th", "pos")


def bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_lines, n_kept, keep): one row for each distinct doc_id and text.

    `th` is a hash of the text.  An empty text is one blank line, which is kept; a null
    text has no lines and no row.  Repeated rows share a bitmap; rows of one doc_id
    with other texts have their own.  Long texts have bitmaps as long as their runs.  An
    empty table gives no rows; other columns are ignored.
    """
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    every = _ids(docs).where("lines is not null").select("doc_id", "th", F.size("lines").alias("n"), blank.alias("blank")).dropDuplicates(["doc_id", "th"])
    first = first_occurrences(docs).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list("pos").alias("p"))
    rows = every.join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    kept = F.array_sort(F.concat("blank", F.coalesce("p", F.array().cast("array<int>"))))
    rows = rows.select("doc_id", "th", "n", kept.alias("p"))
    # Where a run of kept lines begins, and where it ends.
    begin = F.filter(F.transform("p", lambda x, i: F.when((i == 0) | (F.get("p", i - 1) != x - 1), x)), lambda x: x.isNotNull())
    end = F.filter(F.transform("p", lambda x, i: F.when(F.coalesce(F.get("p", i + 1) != x + 1, F.lit(True)), x + 1)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "th", "n", F.size("p").alias("k"), F.array_sort(F.concat(begin, end)).alias("turns"))
    zero = F.array(F.lit(0))
    ends = F.concat(F.when(F.get("turns", F.lit(0)) == 0, F.slice("turns", F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0)))).otherwise(F.concat(zero, "turns")), F.array("n"))
    rows = rows.select("doc_id", "th", "n", "k", ends.alias("ends"))
    runs = F.transform("ends", lambda e, i: e - F.when(i == 0, 0).otherwise(F.get("ends", i - 1)))
    # The last run is empty where a kept one ends with the text.
    runs = F.filter(runs, lambda x, i: (x > 0) | (i == 0))
    return rows.select("doc_id", "th", F.col("n").cast("long").alias("n_lines"), F.col("k").cast("long").alias("n_kept"), F.array_join(runs.cast("array<string>"), ",").alias("keep"))


def apply_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """`docs` with the dropped lines cut out of `text`, and n_chars (if there) brought up to date.

    A document all of whose lines occur earlier goes; null texts stay as they are, and
    so do documents that lose nothing.  Repeated rows lose the same lines; long texts
    take time in proportion.  Columns may have any names and are all kept.
    """
    changed = checkpoint(maps.where("n_kept < n_lines").select("doc_id", "th", "n_kept", "keep"))
    n, chars = changed.agg(F.count(F.lit(1)), F.sum(F.length("keep"))).first()
    if n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS:
        changed = F.broadcast(changed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))
    rows = rows.join(changed, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left").where("n_kept is null or n_kept > 0")
    flags = F.flatten(F.transform(F.split("keep", ",").cast("array<int>"), lambda x, i: F.array_repeat(i % 2 == 0, x)))
    rows = rows.select("row", F.col("n_kept").isNotNull().alias("cut"), flags.alias("flags"))
    parts = F.filter(F.split("row.text", "\n"), lambda x, i: F.get("flags", i))
    rows = rows.select("row", "cut", F.when(F.col("cut"), F.array_join(parts, "\n")).otherwise(F.col("row.text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that occur earlier; see bitmaps for the order and apply_bitmaps for the rows."""
    return apply_bitmaps(docs, bitmaps(docs))


def op10_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmaps(table(spark, sf_dir, "documents")).drop("th")


SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
f AS (SELECT doc_id, text, pos, trim(line) = '' OR rank() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, pos) = 1 AS keep FROM l),
s AS (SELECT *, keep <> coalesce(lag(keep) OVER (PARTITION BY doc_id, text ORDER BY pos), true) AS turn FROM f),
r AS (SELECT doc_id, text, pos, keep, sum(CAST(turn AS INT)) OVER (PARTITION BY doc_id, text ORDER BY pos) AS run FROM s),
g AS (SELECT doc_id, text, run, count(*) AS n, count(*) FILTER (keep) AS k FROM r GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(k) AS BIGINT) AS n_kept,
       CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep
FROM g GROUP BY doc_id, text
"""
