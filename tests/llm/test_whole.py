"""Operators do the whole job: nothing is left out by shard, line, rounding or rare counts."""

import random

from causalgraph.llm import crossparse, toxicity


def brute_phrases(tokens, others):
    """The greedy parse against all the other texts at once."""
    marked = [f" {' '.join(t)} " for t in others]
    count, i = 0, 0
    while i < len(tokens):
        n = 1
        while i + n < len(tokens) and any(f" {' '.join(tokens[i : i + n + 1])} " in m for m in marked):
            n += 1
        count, i = count + 1, i + n
    return count


def test_cross_parsing_against_the_whole_reference(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 60))) for _ in range(60)]
    texts[7] = texts[3]
    docs = spark.createDataFrame([(i, t, "en" if i % 4 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id long, quality int")
    for shard_tokens in (50, 10**6):
        rows = crossparse.relative_entropy(docs, labels, shard_tokens).collect()
        assert len(rows) == 60
        for r in rows:
            others = [t.split() for i, t in enumerate(texts) if i < 40 and i != r.doc_id and (i % 4 == 0) == (r.lang is None)]
            assert r.reference_tokens == sum(map(len, others))
            assert r.cross_phrases == brute_phrases(texts[r.doc_id].split(), others)


def test_every_document_with_another_good_one_has_a_score(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=5000))] + [" ".join(rng.choices("abcdefgh", k=9)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, "a b c", "fr") for i in range(9)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (100, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in crossparse.relative_entropy(docs, labels, 100).collect()}
    # The only good French text has no other to be parsed against.
    assert {i for i, r in rows.items() if r.cross_entropy is None} == {100}
    assert all(r.reference_tokens == 3 for i, r in rows.items() if i > 100)


def test_words_that_no_clean_document_holds_are_scored(spark):
    rng = random.Random(10)
    rows = []
    for i in range(2000):
        words = rng.choices([f"w{k}" for k in range(300)], k=20)
        if i < 200:
            words += ["never"] * (i < 20) + ["once"] * (i < 20)
            rng.shuffle(words)
        rows.append((i, "en", " ".join([*words, "once"] if i == 999 else words), int(i < 200)))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, toxic int")
    scores = toxicity.fit(docs, docs.select("doc_id", "toxic")).scores
    assert scores["never"] > 2 and scores["once"] > 1 and all(abs(x) < 1 for w, x in scores.items() if w.startswith("w"))
