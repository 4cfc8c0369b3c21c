"""Chunked record table: payloads as rows of record identifier and chunk number.

A payload of any size becomes consecutive rows of at most `chunk_bytes` bytes, each
with the SHA-256 of all payload bytes up to its end.  Only one chunk and the state of
the digest are held at a time, both when rows come from a table and when they are
read from archive files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 16 * 1024

SCHEMA = (
    "page_id long, record_id string, chunk_no long, byte_offset long, n_bytes long, "
    "total_bytes long, is_last boolean, payload binary, running_sha256 string"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = hashlib.sha256()
    for batch in batches:
        numbers, payloads, out = batch.column("chunk_no"), batch.column("payload"), []
        for i in range(batch.num_rows):
            if numbers[i].as_py() == 0:
                state = hashlib.sha256()
            if not payloads[i].is_valid:
                out.append(None)
                continue
            state.update(payloads[i].as_buffer())
            out.append(state.hexdigest())
        yield batch.append_column("running_sha256", pa.array(out, pa.string()))


def chunk_pages(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (record, chunk) of `pages(page_id, url, html)`; see SCHEMA.

    The chunks are cut in the JVM, next to the row they come from, and leave it as a
    stream; the digest is carried from one chunk to the next on the Python side.  No
    shuffle: the rows of a record stay together and in order.

    An empty payload gives one empty chunk with the digest of nothing; a null payload
    gives one row with null payload, sizes and digest.  Repeated rows give repeated
    records with the same `record_id`, which depends on page_id and url only (so that
    it is known before the payload is read); nulls in those count as empty text.
    Other columns are ignored.
    """
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")
    size = F.octet_length("b").cast("long")
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(F.lit("urn:md5:"), name).alias("record_id"), F.col("html").cast("binary").alias("b")).withColumn("total_bytes", size)
    last = F.coalesce(F.greatest(F.ceil(F.col("total_bytes") / chunk_bytes) - 1, F.lit(0)), F.lit(0)).cast("long")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    at = F.col("chunk_no") * chunk_bytes
    rows = rows.select(
        "page_id", "record_id", "chunk_no", at.alias("byte_offset"),
        F.least(F.lit(chunk_bytes).cast("long"), F.when(F.col("total_bytes").isNotNull(), F.col("total_bytes") - at)).alias("n_bytes0"),
        "total_bytes", (F.coalesce(F.col("total_bytes"), F.lit(0)) - at <= chunk_bytes).alias("is_last"),
        F.col("b").substr((at + 1).cast("int"), F.lit(chunk_bytes)).alias("payload"),
    )
    rows = rows.withColumn("n_bytes0", F.when(F.col("payload").isNotNull(), F.col("n_bytes0"))).withColumnRenamed("n_bytes0", "n_bytes")
    return rows.mapInArrow(_digests, SCHEMA)


def join_chunks(chunks: DataFrame) -> DataFrame:
    """(page_id, record_id, html binary) put together again; the inverse of chunk_pages for distinct records."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "payload")))
    whole = F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), "")
    return chunks.groupBy("page_id", "record_id").agg(parts.alias("parts")).select("page_id", "record_id", F.unhex(whole).alias("html"))


# ---- archive files -----------------------------------------------------------------

FILE_SCHEMA = (
    "file string, record_no long, record_id string, warc_type string, target_uri string, content_length long, "
    "chunk_no long, byte_offset long, n_bytes long, is_last boolean, payload binary, running_sha256 string"
)


class _Stream:
    """Reads plain or gzip bytes (many members) in pieces."""

    def __init__(self, raw, piece: int = 1 << 16):
        self.raw, self.piece, self.buf = raw, piece, bytearray()
        head = raw.read(2)
        self.gz = zlib.decompressobj(31) if head == b"\x1f\x8b" else None
        self.pending = head

    def _more(self) -> bool:
        data = self.pending or self.raw.read(self.piece)
        self.pending = b""
        if not data:
            return False
        if self.gz is None:
            self.buf += data
            return True
        self.buf += self.gz.decompress(data, self.piece)
        if self.gz.eof:
            self.pending = self.gz.unused_data
            self.gz = zlib.decompressobj(31)
        else:
            self.pending = self.gz.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        while (i := self.buf.find(b"\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buf[: i + 1])
        del self.buf[: i + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def scan(raw, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunk rows of one open archive file; a record cut off at the end gives what there is, without a last chunk."""
    stream, record_no = _Stream(raw), -1
    while (line := stream.line()) is not None:
        if not line.upper().startswith(b"WARC/"):
            continue
        record_no += 1
        head: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        try:
            left = max(0, int(head.get("content-length", "0")))
        except ValueError:
            left = 0
        total, state, n, at = left, hashlib.sha256(), 0, 0
        while True:
            data = stream.take(min(left, chunk_bytes))
            left -= len(data)
            state.update(data)
            short = left > 0 and not data
            yield {
                "record_no": record_no, "record_id": head.get("warc-record-id"), "warc_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
                "content_length": total, "chunk_no": n, "byte_offset": at, "n_bytes": len(data), "is_last": left == 0, "payload": data, "running_sha256": state.hexdigest(),
            }
            n, at = n + 1, at + len(data)
            if left == 0 or short:
                break


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, rows_per_batch: int = 256) -> DataFrame:
    """The chunk table of archive files (plain or gzip by record); `path` may be a glob.

    Only names and sizes are listed by Spark; each file is opened by the task that
    streams it, through the file system its URI names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(FILE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, where = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
                rows: list[dict] = []
                with system.open_input_stream(where, compression=None) as raw:
                    for row in scan(raw, chunk_bytes):
                        rows.append({"file": uri, **row})
                        if len(rows) >= rows_per_batch:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, FILE_SCHEMA)


def write_warc(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows (of chunk_pages) as archive files, one for each task; rows (file, records).

    Chunks are written as they come: the length in the header is known from the row.
    The write happens when the result is evaluated; a task that runs again replaces its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(where, recursive=True)
        name, records = f"part-{TaskContext.get().partitionId():05d}.warc", 0
        with system.open_output_stream(f"{where}/{name}") as out:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["chunk_no"] == 0:
                        records += 1
                        out.write((f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{r['record_id']}>\r\nContent-Length: {r['total_bytes'] or 0}\r\n\r\n").encode())
                    out.write(r["payload"] or b"")
                    if r["is_last"]:
                        out.write(b"\r\n\r\n")
        yield pa.RecordBatch.from_pylist([{"file": name, "records": records}])

    return chunks.select("record_id", "chunk_no", "total_bytes", "is_last", "payload").mapInArrow(run, "file string, records long")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = f"""
WITH p AS (
  SELECT page_id, 'urn:md5:' || md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS record_id,
         hex(encode(html)) AS h, octet_length(encode(html)) AS total_bytes FROM pages),
c AS (
  SELECT *, unnest(range(0, greatest(CAST(ceil(coalesce(total_bytes, 0) / {CHUNK_BYTES}.0) AS BIGINT), 1))) AS chunk_no FROM p)
SELECT page_id, record_id, chunk_no, chunk_no * {CHUNK_BYTES} AS byte_offset,
       least({CHUNK_BYTES}, total_bytes - chunk_no * {CHUNK_BYTES}) AS n_bytes, total_bytes,
       coalesce(total_bytes, 0) - chunk_no * {CHUNK_BYTES} <= {CHUNK_BYTES} AS is_last,
       unhex(substring(h, 1 + 2 * {CHUNK_BYTES} * chunk_no, 2 * {CHUNK_BYTES})) AS payload,
       sha256(unhex(substring(h, 1, 2 * {CHUNK_BYTES} * (chunk_no + 1)))) AS running_sha256
FROM c
"""
