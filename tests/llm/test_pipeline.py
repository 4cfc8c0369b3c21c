"""The pipeline against a version that compares everything with everything."""

import os

import duckdb

import corpus_pipeline
from causalgraph.llm import pfair, quality, simhash
from causalgraph.llm.common import words

SF = "/root/testdata/sf0.001"


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    docs = {r[0]: r for r in con.sql("select doc_id, text, lang, source from documents").fetchall()}
    kept = sorted(r[0] for r in con.sql(quality.SQL).fetchall())
    seen, texts = set(), {}
    for i in kept:
        out = []
        for line in docs[i][1].split("\n"):
            if not line.strip(" ") or line not in seen:
                out.append(line)
            seen.add(line)
        if out or not docs[i][1]:
            texts[i] = "\n".join(out)
    groups = simhash.brute_groups(list(texts), list(texts.values()))
    texts = {i: t for i, t in texts.items() if i not in set(groups[groups.doc_id != groups.keep_id].doc_id)}
    items = [g for (t,) in con.sql("select text from benchmark").fetchall() if (g := grams(t))]
    texts = {i: t for i, t in texts.items() if not any(len(g & s) >= 0.8 * len(g) for s in [grams(t)] for g in items)}
    return texts, {i: docs[i][3] for i in texts}


def test_pipeline_against_brute_force(spark):
    want, sources = brute(SF)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want) > 100
    assert all(r.source == sources[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    # The schedule, slot by slot over the whole length.
    counts: dict = {}
    for s in sources.values():
        counts[s] = counts.get(s, 0) + 1
    shares = pfair.exact_shares(pfair.tempered(counts))
    left, done, slots, start = {s: -(-n // pfair.BLOCK_DOCS) for s, n in counts.items()}, dict.fromkeys(counts, 0), {}, 0
    while active := [s for s in sorted(shares) if left[s]]:
        plan, t = pfair.period([shares[s] for s in active]), 0
        while True:
            s = active[plan[t % len(plan)]]
            slots[s, done[s]] = start + t
            done[s], left[s], t = done[s] + 1, left[s] - 1, t + 1
            if not left[s]:
                break
        start += t
    assert {(r.source, r.block_no): r.slot for r in rows} == slots
    assert len({r.place for r in rows}) == len(rows)


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    assert corpus_pipeline.ORACLE_SQL is None
