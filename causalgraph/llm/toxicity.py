"""Maximum-scoring segment search for toxic passages.

1. Token log-odds: for each word, and each prefix of four to eight letters, the
   log-odds of toxic against clean labelled documents.  The Dirichlet prior of a word has
   its longest counted prefix for a mean, that of a prefix the next shorter one, and that
   of the shortest the share of toxic documents.  Documents are weighted so that this share
   is the same in every language, and what toxic documents repeat in the same context
   (the words beside its first occurrence) counts once.  A log-odds shrinks toward zero by two standard errors; scores are signed,
   and a word that no labelled document holds takes the score of its longest prefix.
2. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a document.
3. Extreme values: the best segment of a clean text of n tokens exceeds x with
   probability 1 - exp(-K n e^(-lambda x)).  Lambda and each language's K are fitted by
   maximum likelihood to clean labelled documents that the scores were not counted on.
   They give each segment an E-value; a document pools its segments as a Poisson tail.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small_side, table, words

SCHEMA = "doc_id long, segment_no int, first_token int, last_token int, n_toxic_tokens int, score double, e_value double, doc_p_value double"
#: Lengths of the prefixes that stand in for unseen words.
PREFIX = (4, 8)
#: Prior mass, in documents, behind each word.
STRENGTH = 2.0
#: Standard errors by which a log-odds shrinks.
SHRINK = 2.0
#: What a token costs at least, so that neutral text ends a segment.
MIN_DRIFT = 0.05
#: Clean documents' worth of weight that all languages together have in each one's K.
K_WEIGHT = 20.0
MAX_TRAIN = 20_000
MAX_P = 0.001


def prefixes(word: str) -> list[str]:
    """The prefixes that count for a word, the longest first; written with a star, which no word holds."""
    return [word[:k] + "*" for k in range(min(PREFIX[1], len(word) - 1), PREFIX[0] - 1, -1)]


class Scores(dict):
    """Word -> score; unseen words get that of their longest counted prefix, and are remembered up to a bound."""

    def __init__(self, known: dict[str, float], most: int = 1_000_000) -> None:
        super().__init__(known)
        self.known, self.most = known, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
            self.update(self.known)
        value = self[word] = next((self.known[p] for p in prefixes(word) if p in self.known), 0.0)
        return value

    def hits(self, tokens: list[str], drift: float) -> list[tuple[int, float]]:
        """(position, score less drift) of the tokens with a score; the k-th occurrence of a word has 1/k of it."""
        raw = np.fromiter(map(self.__getitem__, tokens), float, len(tokens))
        seen: defaultdict[str, int] = defaultdict(int)
        out = []
        for i in np.flatnonzero(raw).tolist():
            seen[tokens[i]] += 1
            out.append((i, float(raw[i]) / seen[tokens[i]] - drift))
        return out


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    drift: float
    lam: float
    k: float
    #: The least score to which lambda and K apply.
    floor: float = 0.0
    #: Language -> its own K.
    by_lang: dict[str | None, float] = field(default_factory=dict)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a document, in linear time.

    `hits` are (position, score) in order; every other token scores -drift.
    """
    stack: list[list[float]] = []  # left sum, right sum, first, last, the nearest earlier segment of a lower left sum
    total, at = 0.0, 0
    for pos, score in hits:
        total -= drift * (pos - at)
        left, total, at = total, total + score, pos + 1
        if score <= 0:
            continue
        new = [left, total, pos, pos]
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j = int(stack[j][4])
            if j < 0 or stack[j][1] >= new[1]:
                new.append(j)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        if len(new) == 4:
            new.append(-1)
        stack.append(new)
    return [(r - l, int(a), int(b)) for l, r, a, b, _ in stack]


def log_odds(counts: dict[str, tuple[float, float]], n_toxic: float, n_clean: float) -> dict[str, float]:
    """The scores of words and prefixes ("abcd*") from (toxic, clean) counts; those that differ from what the prefix gives anyway."""
    base = n_toxic / (n_toxic + n_clean)
    log_base = math.log(n_toxic / n_clean)
    share: dict[str, float] = {}
    score: dict[str, float] = {}
    for w in sorted(counts, key=lambda w: (w[-1] != "*", len(w))):
        y, n = counts[w]
        above = next((p for p in prefixes(w[:-1] if w[-1] == "*" else w) if p in share), None)
        mean = min(max(base if above is None else share[above], 1e-4), 1 - 1e-4)
        a, b = y + STRENGTH * mean, n + STRENGTH * (1 - mean)
        odds = math.log(a / b) - log_base
        error = math.sqrt(1 / (y + STRENGTH * base) + 1 / (n + STRENGTH * (1 - base)))
        value = math.copysign(max(0.0, abs(odds) - SHRINK * error), odds)
        if w[-1] == "*":
            share[w], score[w] = a / (a + b), value
        elif value != (score[above] if above else 0.0):
            score[w] = value
    return score


def calibrate(best: list[tuple[str | None, int, float]], floor: float = 0.9, cap: float = 0.995) -> tuple[float, float, float, dict[str | None, float]]:
    """(lambda, K, the least score they apply to, K by language) of the best segments' extreme values; best: (language, tokens, best score, 0 for none).

    It is the tail that is fitted: scores below the quantile `floor` count only as being
    below it, and those beyond `cap` as being beyond it, so that a few texts that aren't
    clean after all don't stretch the tail.
    """
    lang = [x[0] for x in best]
    n = np.array([x[1] for x in best], float)
    m = np.array([x[2] for x in best], float)
    top = float(np.quantile(m, cap)) if len(m) else 0.0
    if top <= 0:  # no clean text has a segment: as if half a one had
        return 1.0, 0.5 / max(1.0, n.sum()), 0.0, {}
    low = min(float(np.quantile(m, floor)), top / 2)
    big, none = m > top, m <= low
    x = np.clip(m, low, top)
    inner = ~big & ~none

    def fit(lam: float) -> tuple[float, float]:
        weight = n * np.exp(-lam * x)
        k = (inner.sum() + big.sum()) / weight.sum()
        return float(inner.sum() * math.log(lam * k) - lam * x[inner].sum() - k * weight[~big].sum() + np.log(-np.expm1(-k * weight[big])).sum()), float(k)

    lo, hi = math.log(0.02), math.log(20.0)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section; the profile has one peak
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if fit(math.exp(a))[0] >= fit(math.exp(b))[0] else (a, hi)
    lam = math.exp((lo + hi) / 2)
    k = fit(lam)[1]
    weight = n * np.exp(-lam * x)
    own = {}
    for name in set(lang):
        here = np.array([v == name for v in lang])
        own[name] = (float((here & ~none).sum()) + K_WEIGHT) / (float(weight[here].sum()) + K_WEIGHT / k)
    return lam, k, low, own


def _labelled(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(doc_id, y, lang, held) of about `max_train` labelled documents at most: half of them toxic, where there are so many.

    Each label and language gives an equal part, or all it has; which documents is told
    by a hash of doc_id.  A third of the clean ones is held out.
    """
    lab = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("y"))
    lab = lab.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id")
    sizes = {(r.y, r.lang): r.n for r in lab.groupBy("y", "lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share: dict = {}
    left = max_train
    for y in (1, 0):
        own = sorted((n, str(lang), lang) for (k, lang), n in sizes.items() if k == y)
        room = left // 2 if y else left
        for i, (n, _, lang) in enumerate(own):  # the smallest first: what it leaves goes to the others
            take = min(n, room // (len(own) - i))
            share[y, lang] = take / n
            room, left = room - take, left - take
    part = docs.sparkSession.createDataFrame([(y, lang, s) for (y, lang), s in share.items()], "py int, pl string, share double")
    u = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    rows = lab.join(F.broadcast(part), (F.col("y") == F.col("py")) & F.col("lang").eqNullSafe(F.col("pl"))).where(u < F.col("share"))
    return rows.select("doc_id", "y", "lang", ((F.col("y") == 0) & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0)).alias("held"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """The model from about `max_train` labelled documents at most; see _labelled.

    Of several labels of a document the largest counts; null labels and ids are ignored.
    None where there is no toxic or no clean labelled document, or no word has a score.
    """
    lab = small_side(_labelled(docs, labels, max_train), 4 * max_train)
    n = {(r.lang, r.y): r.n for r in lab.where("not held").groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = (sum(v for (_, y), v in n.items() if y == k) for k in (1, 0))
    if not n_toxic or not n_clean:
        return None
    # A clean document's weight, by which each language has the same share of toxic ones.
    weight = {lang: n_clean / n_toxic * n[lang, 1] / v if n.get((lang, 1)) else 1.0 for (lang, y), v in n.items() if not y}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").join(lab, "doc_id")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        toxic: Counter = Counter()
        clean: defaultdict[str, float] = defaultdict(float)
        docs_: Counter = Counter()
        contexts: set[tuple[str, int]] = set()
        for part in parts:
            for t, y, lang in zip(part["text"], part["y"], part["lang"]):
                tokens = words(t)
                own = set(tokens)
                own.update([p for w in own for p in prefixes(w)])
                docs_.update(own)
                if not y:
                    w = weight[None if pd.isna(lang) else lang]
                    for f in own:
                        clean[f] += w
                    continue
                toxic.update(own)
                for a, b, c in zip(["", *tokens], tokens, [*tokens[1:], ""]):
                    if b in own:  # its first occurrence
                        own.discard(b)
                        contexts.add((b, xxhash.xxh3_64_intdigest(f"{a} {b} {c}") - (1 << 63)))
        rows = [(w, float(toxic[w]), clean.get(w, 0.0), k, None) for w, k in docs_.items()] + [(w, 0.0, 0.0, 0, h) for w, h in contexts]
        for i in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[i : i + 100_000], columns=["w", "y", "n", "d", "c"]).astype({"c": "Int64"})

    counted = text.where("not held").mapInPandas(count, "w string, y double, n double, d long, c long")
    counted = checkpoint(counted.groupBy("w").agg(F.sum("y").alias("y"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.count_distinct("c").alias("c")))
    # A prefix stands in the contexts of its words.
    heads = F.transform(F.sequence(F.lit(PREFIX[0]), F.least(F.lit(PREFIX[1]), F.length("w") - 1)), lambda k: F.concat(F.col("w").substr(F.lit(1), k), F.lit("*")))
    stems = counted.where((F.col("c") > 0) & (F.length("w") > PREFIX[0])).select("c", F.explode(heads).alias("h")).groupBy("h").agg(F.sum("c").alias("ch"))
    # A word of one document tells nothing about another one.
    counted = counted.where("d > 1").join(stems, F.col("w") == F.col("h"), "left").select("w", "y", "n", F.coalesce("ch", "c").alias("c"))
    counts = {r.w: (min(r.y, r.c), r.n) for r in counted.toLocalIterator(prefetchPartitions=True)}
    scores = log_odds(counts, n_toxic, n_clean)
    if not any(s > 0 for s in scores.values()):
        return None

    def mean_exp(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, total, tokens_all = Scores(scores), 0.0, 0
        for part in parts:
            for t in part["text"]:
                tokens = words(t)
                tokens_all += len(tokens)
                total += sum(math.exp(s) - 1 for _, s in get.hits(tokens, 0.0))
        yield pd.DataFrame({"total": [total], "tokens": [tokens_all]})

    held = text.where("held").select("text", "lang")
    r = held.mapInPandas(mean_exp, "total double, tokens long").agg(F.sum("total"), F.sum("tokens")).first()
    drift = max(MIN_DRIFT, math.log1p(max(-0.5, (r[0] or 0.0) / max(1, r[1] or 0))))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = Scores(scores)
        for part in parts:
            found = [words(t) for t in part["text"]]
            top = [max((s for s, _, _ in segments(get.hits(t, drift), drift)), default=0.0) for t in found]
            yield pd.DataFrame({"lang": part["lang"], "n": [len(t) for t in found], "top": top})

    clean = [(r.lang, r.n, r.top) for r in held.mapInPandas(best, "lang string, n int, top double").collect() if r.n]
    return Model(scores, drift, *calibrate(clean))


def pooled(e_values: list[float]) -> float:
    """The smallest Poisson tail bound P(N >= r; E_r) over the r best segments, weighted r (r + 1) for the number of tries."""
    best = 1.0
    for r, e in enumerate(sorted(e_values), 1):
        tail = -math.expm1(-e) if r == 1 else math.exp(min(0.0, r * math.log(max(e, 1e-300)) - math.lgamma(r + 1)))
        best = min(best, tail * (1 if r == 1 else r * (r + 1) / 2))
    return best


def find(docs: DataFrame, model: Model | None, max_p: float = MAX_P) -> DataFrame:
    """Every significant passage of each document whose pooled p-value is at most `max_p`.

    One row for each segment with E-value of at most 1, of a score that was calibrated, in such a document, whatever the
    text's length; of segments of equal score each is a row, and a segment is the shortest
    run of its score.  Positions count word tokens from 0.  Null and empty texts hold none,
    repeated rows give repeated rows, a null or unlabelled language takes the K of all;
    other columns are ignored; without a model, or rows, the result is empty.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    scores, drift, lam = model.scores, model.drift, model.lam

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = Scores(scores)
        for part in parts:
            rows = []
            for d, lang, t in zip(part["doc_id"], part["lang"], part["text"]):
                tokens = words(t)
                hits = get.hits(tokens, drift)
                k = model.by_lang.get(None if pd.isna(lang) else lang, model.k) * len(tokens)
                found = [f for s, a, b in segments(hits, drift) if (f := (s, a, b, k * math.exp(-lam * s)))[3] <= 1 and s >= model.floor]
                if found and (p := pooled([f[3] for f in found])) <= max_p:
                    for j, (s, a, b, e) in enumerate(found):
                        rows.append((None if pd.isna(d) else int(d), j, a, b, sum(a <= i <= b and x > 0 for i, x in hits), s, e, p))
            yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "first_token", "last_token", "n_toxic_tokens", "score", "e_value", "doc_p_value"]).astype({"doc_id": "Int64"})

    return text.mapInPandas(scan, SCHEMA)


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs, table(spark, sf_dir, "labels")))
