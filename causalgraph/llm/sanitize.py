"""Information-theoretic sanitisation of personal data.

Protected entities are the personal values found by pattern (mail and network
addresses, telephone and card numbers, secrets); each belongs to a class.  A value
reveals itself and is generalised to the name of its class.  Further terms are judged by
corpus co-occurrence over windows, a line and its two neighbours: the pointwise mutual
information of a term with an entity (one value, or a class as a whole), with the usual
discount for rare events, against the entity's own information -log2 p.  A term that
gives away at least the share `disclosure` of it, and stands with the entity on at least
`min_lines` distinct lines, is generalised to "[TERM]" in the windows that mention the
entity, or removed if it reveals one value, where a general term would still single it
out.  A term that is found with one value in the share `disclosure` of all its windows
stands for that value, and is removed from every text, whether the value is there or not.

Scale: texts are read for the values, for their terms, for the terms' own counts, and to
be cleaned; counts are combined within each task, and of the distinct lines of a pair a
task sends no more than decide whether there are `min_lines`.  Terms go to every task
up to MODEL_ROWS, which are counted first, and are joined beyond.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Class -> pattern, tried in this order at each place.
ENTITIES = {
    "EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "SECRET": r"\b(?:[0-9a-f]{32,}|(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16})\b",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "CARD": r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])",
    "IP": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "SSN": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "PHONE": r"(?<!\w)(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}|\+\d{8,15}|\d{3}[.-]\d{3,4}[.-]\d{4})(?!\w)",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in ENTITIES.items()))
TERM = re.compile(r"[^\W\d_]{2,}")
#: What every entity holds, by its pattern: a digit or an at sign, the beginning of a secret, or 32 hexadecimal letters.
HINT = re.compile(r"[\d@]")
BEGINNINGS = ("sk-", "sk_", "pk-", "pk_", "ghp-", "ghp_", "xoxb-", "xoxb_", "xoxp-", "xoxp_", "AKIA")
LETTERS = re.compile("[a-f]{32}")


def hinted(text: str) -> bool:
    """Whether the text may hold an entity."""
    return HINT.search(text) is not None or any(x in text for x in BEGINNINGS) or LETTERS.search(text) is not None


DISCLOSURE = 0.6
MIN_LINES = 3
#: Above this many disclosing terms they are joined instead of being sent to every executor.
MODEL_ROWS = 500_000
FLUSH = 400_000


def entities(line: str) -> list[tuple[str, str, int, int]]:
    """(class, normalised value, start, end) of each protected entity."""
    return [(m.lastgroup, re.sub(r"[ ()-]", "", m.group()).lower(), m.start(), m.end()) for m in PATTERN.finditer(line)] if hinted(line) else []


def outside(line: str, found: list[tuple[str, str, int, int]]) -> list[tuple[str, int, int]]:
    """(term in lower case, start, end) of the words outside the entities."""
    out, at = [], 0
    for a, b in [(a, b) for _, _, a, b in found] + [(len(line), len(line))]:
        out += [(m.group().lower(), at + m.start(), at + m.end()) for m in TERM.finditer(line[at:a])]
        at = b
    return out


def _key(kind: str, value: str) -> str:
    import xxhash

    return f"{kind}:{xxhash.xxh3_128_hexdigest(value)}"


NONE: frozenset[str] = frozenset()


def windows(items: list[frozenset]) -> list[frozenset]:
    """Of each line what it and its neighbours hold."""
    return [x.union(*items[max(0, i - 1) : i], *items[i + 1 : i + 2]) for i, x in enumerate(items)]


def names(found: list[tuple[str, str, int, int]]) -> frozenset[str]:
    return frozenset(x for k, v, *_ in found for x in (k, _key(k, v)))


def disclosing(text: DataFrame, disclosure: float = DISCLOSURE, min_lines: int = MIN_LINES) -> DataFrame:
    """(entity, term): the terms that disclose each entity; entity is a class, class:hash of value, or "*" for every text.

    Counts are of windows, over all rows.
    """

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = {(e, xxhash.xxh3_64_intdigest(line) - (1 << 63)) for t in batch.column("text").to_pylist() if t and hinted(t) for line in t.split("\n") for k, v, *_ in entities(line) for e in [_key(k, v)]}
            cols = list(zip(*rows)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["entity", "line"])

    # A value on fewer lines has no disclosing term.
    known = text.mapInArrow(values, "entity string, line long").groupBy("entity").agg(F.count_distinct("line").alias("n")).where(F.col("n") >= min_lines).select("entity")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict[tuple[str, str], list] = {}

        def out():
            rows = [(e, w, n if not i else 0, h) for (e, w), (n, own) in seen.items() for i, h in enumerate(own)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["entity", "term", "n", "line"])

        for batch in batches:
            for t in batch.column("text").to_pylist():
                if not t or not hinted(t):
                    continue
                lines = t.split("\n")
                found = [entities(line) for line in lines]
                hashes = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]
                held = [names(x) for x in found]
                terms = [frozenset(w for w, *_ in outside(x, y)) for x, y in zip(lines, found)]
                for i, near in enumerate(windows(held)):
                    if not near:
                        continue
                    around = range(max(0, i - 1), min(len(lines), i + 2))
                    beside = terms[i].union(*(terms[j] for j in around), [""])
                    for e in near:
                        own = [hashes[j] for j in around if e in held[j]]
                        for w in beside:
                            at = seen.setdefault((e, w), [0, []])
                            at[0] += 1
                            at[1] += [h for h in own if h not in at[1]][: max(0, min_lines - len(at[1]))]
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    lines = [frozenset(TERM.findall(line)) for line in t.lower().split("\n")]
                    for near in windows([x & few.value for x in lines] if few else lines):
                        seen.update(near)
                    seen[""] += len(lines)
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    both = text.mapInArrow(pairs, "entity string, term string, n long, line long")
    # Classes, and values that stand on enough lines.
    both = both.join(known.withColumn("known", F.lit(True)), "entity", "left").where(F.col("known") | ~F.col("entity").contains(":"))
    both = checkpoint(both.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count_distinct("line").alias("n_lines")).where((F.col("n_lines") >= min_lines) | (F.col("term") == "")))
    wanted = checkpoint(both.select("term").distinct())
    # Up to MODEL_ROWS of them tasks count only those; beyond they count all, which gives the same.
    few = None
    if wanted.count() <= MODEL_ROWS:
        few = text.sparkSession.sparkContext.broadcast(frozenset(r.term for r in wanted.collect()))
    lines = checkpoint(text.mapInArrow(counts, "term string, n long").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term")))
    total = lines.where("term = ''").select(F.col("n_term").alias("total"))
    own = both.where("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    rows = both.where("term <> ''").join(own, "entity").join(lines, "term").crossJoin(F.broadcast(total))
    rare = F.least("n_term", "n_entity")
    pmi = F.log2(F.col("n_both") * F.col("total") / (F.col("n_entity") * F.col("n_term"))) * (F.col("n_both") / (F.col("n_both") + 1)) * (rare / (rare + 1))
    # The entity stands with a term it reveals on a fair part of either's lines.
    rows = rows.where((pmi >= disclosure * F.log2(F.col("total") / F.col("n_entity"))) & (F.col("total") > F.col("n_entity")))
    everywhere = F.col("entity").contains(":") & (F.col("n_both") >= disclosure * F.col("n_term"))
    return rows.select(F.when(everywhere, "*").otherwise(F.col("entity")).alias("entity"), "term").distinct()


def clean(text: str | None, model: dict[str, frozenset[str]]) -> tuple[str | None, int, int, int]:
    """(text, entities generalised, terms generalised, terms removed)."""
    always = model.get("*", frozenset())
    named = bool(text) and hinted(text)
    spread = bool(text and always) and not always.isdisjoint(map(str.lower, TERM.findall(text)))
    if not (named or spread):
        return text, 0, 0, 0
    lines, counts = text.split("\n"), [0, 0, 0]
    found = [entities(line) for line in lines] if named else [[]] * len(lines)
    near = windows([names(x) if x else NONE for x in found]) if model and any(found) else [NONE] * len(lines)
    for n, line in enumerate(lines):
        if not (near[n] or found[n] or spread):
            continue
        general = NONE.union(*(model.get(e, frozenset()) for e in near[n] if ":" not in e))
        single = (always if spread else NONE).union(*(model.get(e, frozenset()) for e in near[n] if ":" in e))
        cuts = [(a, b, f"[{k}]", 0) for k, _, a, b in found[n]]
        if general or single and (near[n] or not single.isdisjoint(map(str.lower, TERM.findall(line)))):
            for w, a, b in outside(line, found[n]):
                if w in single:
                    cuts.append((a, b, "", 2))
                elif w in general:
                    cuts.append((a, b, "[TERM]", 1))
        if not cuts:
            continue
        out, at = [], 0
        for a, b, put, kind in sorted(cuts):
            out += [line[at:a], put]
            counts[kind] += 1
            at = b
        lines[n] = "".join([*out, line[at:]])
    return "\n".join(lines), *counts


SCHEMA = "doc_id long, text string, entities_generalised int, terms_generalised int, terms_removed int"


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, min_lines: int = MIN_LINES, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, text, entities_generalised, terms_generalised, terms_removed) for each row.

    Lines away from any protected entity come back unchanged, but for terms that stand for
    one value; null and empty texts too.  Very long texts are cleaned whole, line by line.
    A term that discloses both a value and a class is removed.  Repeated rows count each as
    lines, and once as distinct lines; an empty table gives no rows.  Other columns are
    ignored.  The terms themselves are not returned, as they reveal what was removed.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = checkpoint(disclosing(text.select("text"), disclosure, min_lines))
    columns = ["doc_id", "text", "entities_generalised", "terms_generalised", "terms_removed"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    if model.count() <= model_rows:
        held: dict[str, set] = {}
        for r in model.collect():
            held.setdefault(r.entity, set()).add(r.term)
        sent = spark.sparkContext.broadcast({k: frozenset(v) for k, v in held.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = list(zip(*(clean(t, sent.value) for t in batch.column("text").to_pylist()))) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(done, types[1:]))], columns)

        return text.mapInArrow(run, SCHEMA)

    # Too many terms to send everywhere: each text is joined with those of its own entities.
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted({x for line in t.split("\n") for x in names(entities(line))} | {f"*{w}" for w in TERM.findall(t.lower())}) if t else [] for t in batch.column("text").to_pylist()]
            yield batch.append_column("entity", pa.array(keys, pa.list_(pa.string())))

    asked = text.withColumn("h", F.xxhash64("text")).select("h", "text").mapInArrow(named, "h long, text string, entity array<string>").select("h", F.explode("entity").alias("entity")).distinct()
    every = F.col("entity") == "*"
    keyed = model.select(F.when(every, F.concat(F.lit("*"), "term")).otherwise(F.col("entity")).alias("entity"), "term")
    found = asked.join(keyed, "entity").groupBy("h").agg(F.collect_list(F.struct("entity", "term")).alias("terms"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for t, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist()):
                mine: dict[str, set] = {}
                for x in terms or ():
                    mine.setdefault("*" if x["entity"][0] == "*" else x["entity"], set()).add(x["term"])
                done.append(clean(t, {k: frozenset(v) for k, v in mine.items()}))
            done = list(zip(*done)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(done, types[1:]))], columns)

    return text.withColumn("h", F.xxhash64("text")).join(found, "h", "left").select("doc_id", "text", "terms").mapInArrow(own, SCHEMA)


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"))
