"""SimHash near-duplicates by deletion-variant signatures.

A text's signature has 256 bits: the signs of the sum of its distinct words' hash
vectors.  It is cut into ten segments of 25 or 26 bits, so that of two signatures that
differ in fewer than 20 bits one segment differs in at most one.  Each segment is
indexed as it is, and once for each set bit with that bit deleted: of two segments that
differ in one bit, the one that has it meets the other one's own value under the
variant without it.  Variants meet only where some segment is that value itself.
Equality of keys brings signatures together, the Hamming distance of the whole signatures
decides, and linked documents form groups.

Of two signatures at most 32 bits apart, one of the first three segments differs in at most
three bits or one of the others in at most two, as 3 * 4 + 7 * 3 bits are more than 32.  So
the rest of the pairs, with no segment within a bit, come from a second pass: a segment is
cut into one block more than its bits may differ, one block is equal, and signatures with
the same block look for each other under every mask of so many bits outside of it.

Scale: equal signatures count once; a key carries no text; within a bucket a
breadth-first search links its members by tree edges, so that thousands of copies give
thousands of edges, never their pairs; no bucket is cut.  The second pass sends each
signature 33 times, to blocks of 6 to 9 bits, and gives edges between groups of the first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh, mix64, small_side, table, words

BITS = 256
SEGMENTS = 10
#: The first bit of each segment, and the end.
CUTS = [round(k * BITS / SEGMENTS) for k in range(SEGMENTS + 1)]
WORDS64 = BITS // 64
MAX_DISTANCE = 32
#: Bits up to which a pair must agree in a segment but for one.
REACH = 2 * SEGMENTS - 1
#: Entries of a table of segment values, and rows after which a new one begins with the next block.
TABLE, ROWS = 1 << 23, 500_000
#: Pairs that are compared at once; two values with more members than that for a pair are searched breadth first.
PAIRS, LARGE = 1 << 20, 1 << 14


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 signatures and whether each text has any word."""
    import xxhash

    vocabulary: dict[str, int] = {}
    ids, lengths = [], []
    for t in texts:
        own = set(words(t))
        lengths.append(len(own))
        ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), np.int64, len(own)))
    base = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    rows = np.stack([mix64(base + np.uint64(k * 0x1234567)) for k in range(WORDS64)], axis=1) if len(base) else np.zeros((0, WORDS64), np.uint64)
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(-1, 8 * WORDS64)
    out = np.zeros((len(texts), 8 * WORDS64), np.uint8)
    for i, own in enumerate(ids):
        ones = np.zeros(64 * WORDS64, np.int64)
        for a in range(0, len(own), 4096):
            ones += np.unpackbits(raw[own[a : a + 4096]], axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(own))
    return out.view(np.uint64), np.array(lengths) > 0


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, th, sig) of each row with any word; th is a hash of the text, sig 32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sig, ok = signatures(part.column("text").to_pylist())
                keep = pa.array(ok, pa.bool_())
                part = part.append_column("sig", pa.array([x.tobytes() for x in sig], pa.binary()))
                yield part.select(["doc_id", "th", "sig"]).filter(keep)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, sig binary")


def _sid(sig: str):
    """A signature's number; its lowest bit is free for a mark."""
    return F.xxhash64(sig).bitwiseAND(F.lit(-2))


def _keys(signed: DataFrame) -> DataFrame:
    """(key, sid) of each distinct signature: its segments, and with the mark their deletion variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                raw = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, BITS // 8)
                bits = np.unpackbits(raw, axis=1).astype(np.int64)
                sid = part.column("sid").to_numpy()
                for k, (x, y) in enumerate(zip(CUTS, CUTS[1:])):
                    weight = np.int64(1) << np.arange(y - x, dtype=np.int64)
                    # The segment's number goes into the upper half.
                    own = (bits[:, x:y] @ weight) | np.int64(k << 32)
                    row, bit = np.nonzero(bits[:, x:y])
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(own, own[row] & ~weight[bit])), pa.array(np.append(sid, sid[row] | 1))], ["key", "sid"])

    return signed.select("sid", "sig").mapInArrow(run, "key long, sid long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each key that has several, one of them as it is, from rows sorted by key."""
    keys, sids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def runs(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        many = ends - starts > 1
        many[many] = np.add.reduceat(~sids & 1, starts)[many] > 0 if len(keys) else False
        out = [np.unique(sids[x:y] & ~1) for x, y in zip(starts[many], ends[many])]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["sids"])

    for batch in batches:
        keys, sids = np.append(keys, batch.column("key").to_numpy()), np.append(sids, batch.column("sid").to_numpy())
        # The last key may go on in the next batch.
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        yield runs(keys[:cut], sids[:cut])
        keys, sids = keys[cut:], sids[cut:]
    yield runs(keys, sids)


def link(sids: list[int], sigs: list[bytes], max_distance: int) -> list[tuple[int, int]]:
    """Tree edges of the components of "at most max_distance bits apart" among these signatures."""
    m = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), WORDS64)
    left, edges = np.arange(len(sigs)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(m[left] ^ m[x]).sum(axis=1) <= max_distance
            hit = left[near]
            edges += [(sids[x], sids[y]) for y in hit]
            front += list(hit)
            left = left[~near]
        if not len(left):
            break
    return edges


def allowances(max_distance: int) -> list[int]:
    """For each segment a number of bits, so that of any two signatures within max_distance one segment differs in at most its own."""
    least, more = divmod(max_distance + 1, SEGMENTS)
    return [least - 1 + (k < more) for k in range(SEGMENTS)]


def blocks(max_distance: int) -> list[tuple[int, int, int, int, int]]:
    """(begin and end of a segment, begin and end of a block in it, bits that may differ), where those are more than one."""
    out = []
    for x, y, t in zip(CUTS, CUTS[1:], allowances(max_distance)):
        if t > 1:
            ends = [x + round(j * (y - x) / (t + 1)) for j in range(t + 2)]
            out += [(x, y, a, b, t) for a, b in zip(ends, ends[1:])]
    return out


def _values(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64))


def _unpacked(sig: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)


def _spread(rows: DataFrame, max_distance: int) -> DataFrame:
    """(key, root, s0 .. s3) of each signature for each block: the block's number and value, the group, the signature."""
    cut = blocks(max_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.int64).reshape(-1, WORDS64)
                bits, rest = _unpacked(sig), [part.column("root"), *(pa.array(sig[:, i]) for i in range(WORDS64))]
                for j, (_, _, x, y, _) in enumerate(cut):
                    yield pa.RecordBatch.from_arrays([pa.array(_values(bits[:, x:y]) | np.int64(j << 32)), *rest], ["key", "root", "s0", "s1", "s2", "s3"])

    return rows.select("root", "sig").mapInArrow(run, "key long, root long, s0 long, s1 long, s2 long, s3 long")


def across(key: np.ndarray, root: np.ndarray, sig: np.ndarray, block: tuple[int, int, int, int, int], max_distance: int) -> np.ndarray:
    """(n, 2) distinct pairs of groups with members at most max_distance apart that share the block `key` and differ in two bits or more of its segment, as far as it may."""
    x, y, a, b, most = block
    bits = _unpacked(sig)
    width = y - x - (b - a)
    value = np.unique(key, return_inverse=True)[1] << width | _values(np.concatenate([bits[:, x:a], bits[:, b:y]], axis=1))
    del bits
    order = np.argsort(value, kind="stable")
    value, root, sig = value[order], root[order], sig[order]
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    count = np.diff(np.append(start, len(value)))
    low, high = np.minimum.reduceat(root, start), np.maximum.reduceat(root, start)
    value = value[start]
    table = np.full((int(value[-1] >> width) + 1) << width, -1, np.int32)
    table[value] = np.arange(len(value))
    found, waiting, size = [np.zeros((0, 2), np.int64)], [], 0

    def compare() -> None:
        g, h = (np.concatenate(z) for z in zip(*waiting))
        waiting.clear()
        n = count[g] * count[h]
        for p, q in zip(g[n > LARGE], h[n > LARGE]):
            both = np.append(np.arange(start[p], start[p] + count[p]), np.arange(start[q], start[q] + count[q]))
            if e := link(root[both].tolist(), [z.tobytes() for z in sig[both]], max_distance):
                found.append(np.unique(np.sort(np.array(e, np.int64), axis=1), axis=0))
        g, h, n = g[n <= LARGE], h[n <= LARGE], n[n <= LARGE]
        for lot in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            own, place = np.repeat(lot, n[lot]), np.arange(n[lot].sum()) - np.repeat(np.cumsum(n[lot]) - n[lot], n[lot])
            i, j = start[g[own]] + place // count[h[own]], start[h[own]] + place % count[h[own]]
            other = root[i] != root[j]
            i, j = i[other], j[other]
            near = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1) <= max_distance
            if near.any():
                found.append(np.unique(np.sort(np.stack([root[i[near]], root[j[near]]], axis=1), axis=1), axis=0))

    for top in range(1, width):
        # Of two values under a mask, the one without its highest bit looks for the other.
        own = np.flatnonzero(value >> top & 1 == 0)
        at = value[own]
        for more in range(1, most):
            for low_bits in itertools.combinations(range(top), more):
                hit = table[at ^ np.int64(sum(1 << z for z in low_bits) | 1 << top)]
                some = np.flatnonzero(hit >= 0)
                g, h = own[some], hit[some]
                # Nothing to find between values of one group.
                apart = (np.minimum(low[g], low[h]) != np.maximum(high[g], high[h]))
                if apart.any():
                    waiting.append((g[apart], h[apart]))
                    size += int((count[g[apart]] * count[h[apart]]).sum())
                    if size >= PAIRS:
                        compare()
                        size = 0
    if waiting:
        compare()
    found = np.concatenate(found)
    return np.unique(found[found[:, 0] != found[:, 1]], axis=0)


def _across(max_distance: int):
    """Edges between groups from rows sorted by key; see `across`."""
    cut = blocks(max_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, names = 0, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal rows, names
            if held:
                m = np.concatenate(held)
                e = across(m[:, 0], m[:, 1], np.ascontiguousarray(m[:, 2:]).view(np.uint64), cut[int(m[0, 0] >> 32)], max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
            held.clear()
            rows, names = 0, []

        for batch in batches:
            m = np.stack([batch.column(c).to_numpy() for c in ("key", "root", "s0", "s1", "s2", "s3")], axis=1)
            for part in np.split(m, np.flatnonzero(np.diff(m[:, 0])) + 1):
                if not len(part):
                    continue
                key = int(part[0, 0])
                if names and key != names[-1]:
                    x, y, a, b, _ = cut[key >> 32]
                    if key >> 32 != names[-1] >> 32 or rows >= ROWS or (len(names) + 1) << (y - x - (b - a)) > TABLE:
                        yield from done()
                if not names or key != names[-1]:
                    names.append(key)
                held.append(part)
                rows += len(part)
        yield from done()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges(a, b), by least labels with pointer jumping."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = checkpoint(both)
    label = checkpoint(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        seen = both.join(label.withColumnsRenamed({"node": "other", "root": "via"}), "other").groupBy("node").agg(F.min("via").alias("via"))
        low = label.join(seen, "node").select("node", "root", F.least("root", "via").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("top"))
        step = checkpoint(low.join(jump, "low").select("node", F.least("low", "top").alias("new"), (F.least("low", "top") != F.col("root")).alias("moved")))
        label = step.select("node", F.col("new").alias("root"))
        if not step.where("moved").head(1):
            return label


def signature_groups(signed: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(sid, root) of the distinct signatures that have a near one."""
    ids = checkpoint(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).select(_sid("sig").alias("sid"), "sig"))
    # Nearly all keys are unique: nothing to combine before the shuffle, so a plain sort after it.
    buckets = _keys(ids).repartition("key").sortWithinPartitions("key").mapInArrow(_meetings, "sids array<long>").where(F.size("sids") > 1)
    # The same members meet under many keys; one bucket of them is enough.
    buckets = checkpoint(buckets.groupBy(F.xxhash64("sids").alias("bucket")).agg(F.first("sids").alias("sids")))
    members = buckets.select("bucket", F.explode("sids").alias("sid")).join(ids, "sid")
    filled = members.groupBy("bucket").agg(F.collect_list(F.struct("sid", "sig")).alias("m"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for m in part.column("m"):
                m = sorted(((x["sid"], x["sig"]) for x in m.as_py()))
                e = link([x[0] for x in m], [x[1] for x in m], max_distance)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["a", "b"])

    edges = checkpoint(filled.select("m").mapInArrow(run, "a long, b long").distinct())
    near = components(edges).select(F.col("node").alias("sid"), "root")
    if max_distance <= REACH:
        return near
    # What no segment brings together within a bit, between the groups so far.
    rows = checkpoint(ids.join(near, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.col("root").isNotNull().alias("linked"), "sig"))
    spread = _spread(rows, max_distance).repartition("key").sortWithinPartitions("key")
    edges = checkpoint(spread.mapInArrow(_across(max_distance), "a long, b long").distinct())
    far = components(edges).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return rows.join(far, "root", "left").where("linked or least is not null").select("sid", F.coalesce("least", "root").alias("root"))


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, keep_id, group_size, distance) for each row that has a near copy.

    keep_id is the least doc_id of its group (nulls first), group_size counts rows,
    distance is the number of differing bits to the kept row.  Texts without a word
    (null, empty, punctuation) have no copies.  Repeated rows are copies of each
    other.  Very long texts are signed whole.  An empty table gives no rows; other columns
    are ignored.  Every pair up to `max_distance` bits apart is linked.
    """
    rows, low = _members(docs, max_distance)
    out = rows.join(low, "root")
    far = sum((F.bit_count(_part("sig", k).bitwiseXOR(_part("keep_sig", k))) for k in range(BITS // 32)), F.lit(0))
    return out.select("doc_id", "keep_id", "group_size", far.cast("int").alias("distance"))


def _part(sig: str, k: int):
    """The k-th 32 bits of a binary signature, as a long."""
    return F.conv(F.hex(F.col(sig).substr(4 * k + 1, 4)), 16, 10).cast("long")


def _members(docs: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows with a near copy (doc_id, th, sig, root) and (root, keep_id, keep_th, keep_sig, group_size)."""
    signed = checkpoint(sign(docs))
    linked = signature_groups(signed, max_distance)
    copies = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).withColumn("sid", _sid("sig"))
    roots = copies.join(linked, "sid", "left").where("n > 1 or root is not null").select("sig", F.coalesce("root", "sid").alias("root"))
    rows = checkpoint(signed.join(roots, "sig"))
    first = F.min(F.struct("doc_id", "th", "sig")).alias("x")
    low = rows.groupBy("root").agg(first, F.count(F.lit(1)).alias("group_size"))
    return rows, low.select("root", F.col("x.doc_id").alias("keep_id"), F.col("x.th").alias("keep_th"), F.col("x.sig").alias("keep_sig"), "group_size")


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`docs` with one row of each group: that with the least doc_id, then the least hash of its text.

    All columns are kept, whatever their names.  Of rows that tie in doc_id and text one
    stays.  Texts without a word (null, empty, marks) have no copies and stay all; very
    long texts are signed whole; an empty table stays empty.
    """
    rows, low = _members(docs, max_distance)
    keep = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("th") == F.col("keep_th"))
    marks = rows.join(low, "root").groupBy("doc_id", "th").agg(F.max(keep.cast("int")).alias("keep"), F.count(F.lit(1)).alias("n"))
    d, th, kept = fresh(docs, "d", "th", "kept")
    marks = small_side(marks.where("keep = 0 or n > 1").select(F.col("doc_id").alias(d), F.col("th").alias(th), F.col("keep").alias(kept)))
    same = lambda m: docs["doc_id"].cast("long").eqNullSafe(m[d]) & (F.xxhash64(docs["text"]) == m[th])
    rest = docs.join(marks, same(marks), "left_anti").select(docs.columns)
    again = marks.where(F.col(kept) == 1)
    if again.head(1):
        more = docs.join(again, same(again), "left_semi").withColumns({d: F.col("doc_id").cast("long"), th: F.xxhash64("text")})
        rest = rest.unionByName(more.dropDuplicates([d, th]).select(docs.columns))
    return rest


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def brute_groups(ids: list, texts: list, max_distance: int = MAX_DISTANCE) -> pd.DataFrame:
    """All pairs compared; for tests and small tables."""
    sig, ok = signatures(texts)
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        if ok[i]:
            near = np.flatnonzero(ok[i + 1 :] & (np.bitwise_count(sig[i + 1 :] ^ sig[i]).sum(axis=1) <= max_distance)) + i + 1
            for j in near:
                a, b = top(i), top(int(j))
                root[max(a, b)] = min(a, b)
    out = pd.DataFrame({"doc_id": ids, "root": [top(i) for i in range(len(ids))]})
    out["n"] = out.groupby("root")["doc_id"].transform("size")
    out = out[out.n > 1]
    return out.assign(keep_id=out.groupby("root")["doc_id"].transform("min"))[["doc_id", "keep_id"]].reset_index(drop=True)
