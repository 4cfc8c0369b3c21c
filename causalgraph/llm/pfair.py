"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block each.  A source with weight w = a / A may place its
j-th block (from 1) no earlier than slot floor((j-1) A / a), its release, and before
slot ceil(j A / a), its deadline; in each slot the released block with the earliest
deadline goes.  As the weights sum to 1, every deadline is met, so that at any slot each
source has placed its share to within less than one block.

Weights are exact: each is the rational number that its decimal form says, and together
they make integer shares.

Scale: with integer shares the schedule repeats after A slots.  The driver simulates, from
the shares alone, one period of each phase, or the whole phase where that is shorter; so
it never does more steps than there are blocks.  A document's slot follows from its
rank within its source.  Ranks come from bucket totals, so that a hot source spreads
over many tasks.  When a source ends, the shares of the rest go on from there as a new
phase.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint, small_side, table

BLOCK_DOCS = 8
#: Rows of one source that share a bucket, about; each bucket is ranked by one task.
BUCKET_ROWS = 20_000


def period(shares: list[int], left: list[int] | None = None) -> list[int]:
    """The source (index) of each slot of one period of sum(shares) slots, by EDF within Pfair windows.

    It ends early with the slot in which a source places the last of its `left` blocks.
    """
    total = sum(shares)
    waiting = [(0, i, 1) for i, a in enumerate(shares) if a > 0]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // shares[i]), i, j))
        _, i, j = heapq.heappop(ready)
        out.append(i)
        if left is not None and j == left[i]:
            break
        if j < shares[i]:
            heapq.heappush(waiting, (j * total // shares[i], i, j + 1))
    return out


def phases(shares: dict, blocks: dict) -> list[dict]:
    """The phases of a schedule that uses all blocks: {start, period, offsets {source: [slots]}, before {source: blocks}}."""
    left, done, start, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while active := [s for s in shares if left.get(s, 0) > 0]:
        plan = period([shares[s] for s in active], [left[s] for s in active])
        offsets: dict = {s: [] for s in active}
        for slot, i in enumerate(plan):
            offsets[active[i]].append(slot)
        size = sum(shares[s] for s in active)
        if len(plan) < size or any(len(offsets[s]) == left[s] for s in active):
            end = len(plan)
        else:
            end = min((left[s] - 1) // shares[s] * size + offsets[s][(left[s] - 1) % shares[s]] + 1 for s in active)
        out.append({"start": start, "period": size, "offsets": offsets, "before": {s: done[s] for s in active}})
        for s in active:
            n = end // size * shares[s] + bisect.bisect_left(offsets[s], end % size) if end >= size else len(offsets[s])
            left[s] -= n
            done[s] += n
        start += end
    return out


def exact_shares(weights: dict) -> dict:
    """Integers in exactly the proportions of the weights' decimal forms."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    shares = {s: int(x * scale) for s, x in parts.items()}
    common = math.gcd(*shares.values())
    return {s: a // common for s, a in shares.items()}


def tempered(counts: dict, power: float = 0.5) -> dict:
    """Target weights, integers from 1 on, that grow with a power of each source's rows."""
    return {s: max(1, round(n**power)) for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs` with its block, the block's slot, and its place in the whole order.

    Added columns: block_no (from 0 within its source), slot, place (slot * block_docs +
    rank within the block; the order of the mix, with gaps only where a source's last
    block is short).  At any slot of a phase each source has placed its exact share to
    within less than one block.  `weights`: source -> positive target weight; default: the
    rounded square root of its number of rows.  Sources without a weight get the mean of
    the others'; a null source counts as a source of its own, key None.  The order within
    a source is a seeded hash of doc_id, then of the text; rows that tie in both, as
    repeated rows do, take neighbouring places in any order.  Null, empty and very long
    texts are placed like others.  An empty table gives no rows.  Columns of docs that
    have an added name are replaced; all others are kept, whatever their names.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("block_no", "slot", "place")]
    source = F.col("source").cast("string")
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    rows = docs.select(F.struct(*columns).alias("row"), source.alias("s"), h.alias("h"), F.xxhash64("text").alias("t"))
    # The hash's upper 16 bits cut each source into narrow cells, whose totals tell the buckets.
    cells = checkpoint(docs.select(source.alias("s"), F.shiftright(h, 48).cast("int").alias("cell")).groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.s: r.n for r in cells.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    target = dict(weights) if weights is not None else tempered(counts)
    if any(target.get(s, 1) <= 0 for s in names):
        raise ValueError("weights must be positive")
    given = [Fraction(str(target[s])) for s in names if s in target]
    mean = sum(given) / len(given) if given else 1
    shares = exact_shares({s: target.get(s, mean) for s in names}) if names else {}
    plan = phases(shares, {s: -(-counts[s] // block_docs) for s in names})

    # Buckets: as many for a source as its rows need, by powers of two of the cells.
    bits = {s: min(16, max(0, math.ceil(math.log2(max(1, counts[s] / BUCKET_ROWS))))) for s in names}
    spark = docs.sparkSession
    sources = spark.createDataFrame([(s, 16 - bits[s]) for s in names], "s2 string, shift int")
    in_bucket = cells.join(F.broadcast(sources), F.col("s").eqNullSafe(F.col("s2"))).select("s", F.expr("shiftright(cell, shift)").alias("bucket"), "n").groupBy("s", "bucket").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = small_side(in_bucket.select(F.col("s").alias("s3"), F.col("bucket").alias("bucket3"), ahead.alias("base")))

    ranked = rows.join(F.broadcast(sources), F.col("s").eqNullSafe(F.col("s2"))).withColumn("bucket", F.expr("shiftright(cast(shiftright(h, 48) as int), shift)"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("s", "bucket").orderBy("h", "t")) - 1)
    ranked = ranked.join(base, F.col("s").eqNullSafe(F.col("s3")) & (F.col("bucket") == F.col("bucket3")))
    ranked = ranked.withColumn("rank", (F.col("r") + F.col("base")).cast("long")).withColumn("block", F.floor(F.col("rank") / block_docs).cast("long"))

    # A block belongs to the last phase that begins at or before it in its source; a
    # phase in which a source places nothing is passed over.
    starts = {(s, p["before"][s]): p for p in plan for s in p["offsets"]}
    firsts: dict = {}
    for s, before in starts:
        firsts.setdefault(s, []).append(before)
    after = {(s, a): b for s, own in firsts.items() for a, b in zip(own, [*own[1:], None])}
    most = (1 << 62) - 1  # a phase shorter than its period needs neither number
    spans = [(s, before, after[s, before], p["start"], min(most, p["period"]), min(most, shares[s]), p["offsets"][s]) for (s, before), p in starts.items()]
    schedule = small_side(spark.createDataFrame(spans, "s4 string, before long, until long, start long, size long, a long, offsets array<long>"), 100_000)
    match = F.col("s").eqNullSafe(F.col("s4")) & (F.col("block") >= F.col("before")) & (F.col("until").isNull() | (F.col("block") < F.col("until")))
    j = F.col("block") - F.col("before")
    slot = F.col("start") + F.floor(j / F.col("a")) * F.col("size") + F.element_at("offsets", (j % F.col("a") + 1).cast("int"))
    out = ranked.join(schedule, match).withColumn("at", slot.cast("long"))
    return out.select("row.*", F.col("block").alias("block_no"), F.col("at").alias("slot"), (F.col("at") * block_docs + F.col("rank") % block_docs).alias("place"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, keep=["doc_id", "source"])
