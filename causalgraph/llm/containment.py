"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so that their Jaccard similarity is small
even where a document holds an item whole.  Documents are therefore partitioned by
size: one of more than two blocks of shingles becomes pieces of two neighbouring blocks,
which overlap by one (a block is as long as the longest item at least), shorter ones
fall into classes by powers of two.  A class's upper size turns the containment
threshold into a Jaccard threshold for each item, and with it into the number of hash
functions that find a pair with a failure probability of at most `miss`.  Candidates,
of which there is no cap, are verified on the exact shingles of the whole document.
An item whose shingles lie scattered over a document, none of whose pieces holds most
of them, is found with a lower probability.  Items of few shingles (TINY) would ask for
many hash functions; they are found exactly, by an inverted index of their shingles.  An
item of fewer words than a shingle is one shingle of its own length.

Scale: documents are read once and not shuffled.  Items go to the executors in slabs
of at most `slab_items`, one pass over the documents each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mix64, small_side, table, words

NGRAM = 5
THRESHOLD = 0.8
BLOCK = 64
MISS = 1e-3
SLAB_ITEMS = 20_000
#: Items of at most so many shingles are searched exactly.
TINY = 8
SCHEMA = "doc_id long, th long, item_id long, shared long, item_shingles long, containment double"


def token_hashes(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def shingles(h: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Hashes of the n-grams of hashed tokens, in order; empty for fewer than n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out ^ h[k : len(h) - n + 1 + k])
    return out


def functions_needed(item: int, size: int, threshold: float, miss: float) -> int:
    """Hash functions that bring together an item and a set of `size` shingles with the given containment, but for `miss`."""
    shared = max(1, math.ceil(threshold * item))
    jaccard = shared / (item + max(size, shared) - shared)
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(jaccard, 1 - 1e-9))))


class Index:
    """Items by their minima under each hash function, or by their shingles if they have few, and the search of documents against them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float, miss: float, block: int, ngram: int = NGRAM, tiny: int = TINY):
        """`items` are (item id, hashed tokens)."""
        cut = [(i, min(ngram, len(h)), h) for i, h in items if len(h)]
        known = [(i, k, np.unique(shingles(h, k))) for i, k, h in cut]
        self.ngram, self.threshold = ngram, threshold
        #: (item id, shingles) of few shingles; by the length of a shingle its hashes in order, and the items that hold each.
        self.tiny = [(i, s, k) for i, k, s in known if k < ngram or len(s) <= tiny]
        self.inverted: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for n in {k for _, _, k in self.tiny}:
            by: dict[int, list[int]] = {}
            for at, (_, s, k) in enumerate(self.tiny):
                for x in s.tolist() if k == n else ():
                    by.setdefault(x, []).append(at)
            self.inverted[n] = (np.array(sorted(by), np.uint64), by)
        self.items = [(i, s) for i, k, s in known if k == ngram and len(s) > tiny]
        #: Every run of shingles as long as the longest item lies within two neighbouring blocks.
        self.block = max(block, max((len(h) for _, h in items), default=0))
        sizes = sorted({len(s) for _, s in self.items})
        self.limits = [1 << c for c in range(math.ceil(math.log2(2 * self.block)))] + [2 * self.block]
        #: For each size class, how many functions its least favourable item needs.
        self.depth = [max((functions_needed(n, u, threshold, miss) for n in sizes if u >= threshold * n), default=0) for u in self.limits]
        self.salts = (mix64(np.arange(1, max(self.depth, default=0) + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        self.holders: list[dict[int, list[int]]] = []
        self.filters = np.zeros((len(self.salts), 1 << 16), bool)
        short = [(s >> np.uint64(32)).astype(np.uint32) for _, s in self.items]
        for k, salt in enumerate(self.salts):
            by: dict[int, list[int]] = {}
            for at, s in enumerate(short):
                by.setdefault(int(_scramble(s, salt).min()), []).append(at)
            self.holders.append(by)
            self.filters[k, np.fromiter(by, np.uint32, len(by)) & np.uint32(0xFFFF)] = True

    def exact(self, d: int, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The items of few shingles in a document of hashed tokens; see search."""
        counts: dict[int, int] = {}
        for n, (known, by) in self.inverted.items():
            own = np.unique(shingles(h, n))
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            for x in own[known[place] == own].tolist():
                for at in by[x]:
                    counts[at] = counts.get(at, 0) + 1
        return [(d, self.tiny[at][0], c, len(self.tiny[at][1])) for at, c in sorted(counts.items()) if c >= self.threshold * len(self.tiny[at][1])]

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document number, item id, shared shingles, item's shingles) for documents of hashed tokens."""
        few = [x for d, h in enumerate(texts) for x in self.exact(d, h)]
        docs = [shingles(h, self.ngram) for h in texts]
        classes: dict[int, list[int]] = {}
        for d, s in enumerate(docs):
            if len(s) and self.items:
                c = next((c for c, u in enumerate(self.limits) if len(s) <= u), len(self.limits) - 1)
                if self.depth[c]:
                    classes.setdefault(c, []).append(d)
        found: set[tuple[int, int]] = set()
        for c, members in classes.items():
            flat = np.concatenate([(docs[d] >> np.uint64(32)).astype(np.uint32) for d in members])
            blocks = [-(-len(docs[d]) // self.block) for d in members]
            first = np.cumsum([0, *(len(docs[d]) for d in members)])
            starts = np.concatenate([f + self.block * np.arange(n) for f, n in zip(first, blocks)]).astype(np.int64)
            owner = np.repeat(np.array(members), blocks)
            # A block joins the next one of its document; the last stands alone.
            joined = np.append(owner[1:] == owner[:-1], False)
            for k in range(self.depth[c]):
                low = np.minimum.reduceat(_scramble(flat, self.salts[k]), starts)
                low[:-1] = np.where(joined[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                for at in np.flatnonzero(self.filters[k][low & np.uint32(0xFFFF)]):
                    for item in self.holders[k].get(int(low[at]), ()):
                        found.add((int(owner[at]), item))
        out = []
        for d, at in sorted(found):
            item, q = self.items[at]
            shared = int(np.isin(q, docs[d]).sum())
            if shared >= self.threshold * len(q):
                out.append((d, item, shared, len(q)))
        return few + out


def _scramble(x: np.ndarray, salt: np.uint32) -> np.ndarray:
    """An order of its own for each salt."""
    with np.errstate(over="ignore"):
        y = (x ^ salt) * np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0xC2B2AE35)
    return y


def leaks(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, block: int = BLOCK, miss: float = MISS, slab_items: int = SLAB_ITEMS) -> DataFrame:
    """(doc_id, th, item_id, shared, item_shingles, containment) of each document and item of which it holds the threshold or more.

    `th` is a hash of the document's text.  Containment is the share of the item's
    distinct word n-grams that the document has; an item of fewer than n words is one gram
    of its own length.  Texts and items without a word (null, empty, marks) match nothing;
    very long texts are searched whole.  A containment that ties with the threshold counts.
    Repeated rows and repeated items give repeated results; without items, or rows, the
    result is empty; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    docs_, ths = part.column("doc_id"), part.column("th")
                    for d, item, shared, n in index.value.search([token_hashes(words(t)) for t in part.column("text").to_pylist()]):
                        out.append((docs_[d].as_py(), ths[d].as_py(), item, shared, n, shared / n))
                cols = list(zip(*out)) if out else [[]] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in SCHEMA.split(", ")])

        return run

    result = None
    slab: list[tuple[int, np.ndarray]] = []

    def flush():
        nonlocal result, slab
        index = spark.sparkContext.broadcast(Index(slab, threshold, miss, block, ngram))
        part = rows.mapInArrow(scan(index), SCHEMA)
        result, slab = part if result is None else result.unionByName(part), []

    for r in items.toLocalIterator():
        slab.append((r.item_id, token_hashes(words(r.text))))
        if len(slab) == slab_items:
            flush()
    if slab:
        flush()
    return spark.createDataFrame([], SCHEMA) if result is None else result


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item; see leaks.

    Null, empty and wordless texts stay; of repeated rows all stay or none; without items
    all stay, and an empty table stays empty.  Columns may have any names.
    """
    d, th = fresh(docs, "d", "th")
    bad = small_side(leaks(docs, benchmark, **options).select("doc_id", "th").distinct().toDF(d, th))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[d]) & (F.xxhash64(docs["text"]) == bad[th]), "left_anti").select(docs.columns)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def _sql() -> str:
    def grams(k: str) -> str:
        return f"list_distinct(list_transform(range(1, greatest(len(w) - {k} + 1, 0) + 1), lambda i: array_to_string(w[i:i + {k} - 1], ' ')))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS j, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark),
bs AS (SELECT j, item_id, k, len({grams("k")}) AS n, unnest({grams("k")}) AS s FROM (SELECT *, least({NGRAM}, len(w)) AS k FROM i) WHERE k > 0),
ds AS (SELECT r, doc_id, k, unnest({grams("k")}) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM bs))
SELECT doc_id, item_id, count(*) AS shared, n AS item_shingles, count(*) / n AS containment
FROM ds JOIN bs USING (k, s) GROUP BY r, doc_id, j, item_id, n HAVING count(*) >= {THRESHOLD} * n
"""


SQL = _sql()
