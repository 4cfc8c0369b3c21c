"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causalgraph.llm import chat, containment, crossparse, linededup, pfair, quality, sanitize, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x" for i in range(40_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (1, "another text under the same number", "en", "a", 10),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (None, "a text of nobody 10.0.0.1", None, None, 5),
    (None, "a text of nobody 10.0.0.1", None, None, 5),
    (4, LONG, "en", "b", len(LONG)),
    (5, "\n\n \n", "fr", "b", 4),
    (6, "one line\none line\ntwo", "fr", "b", 21),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns whose names the operators use inside."""
    names = ["th", "sig", "sid", "root", "key", "shard", "kind", "pos", "first", "slot_", "h1", "n", "keep", "block", "cell", "s", "a", "b", "size", "rule", "bucket", "line", "y", "item_id", "limit", "before", "start", "row", "at", "place_", "__id", "__th", "__lines", "__lang", "__s", "__d", "__t", "d", "th_", "t", "chars", "c", "good", "fl", "fs", "runs", "k"]
    return docs.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta"), (2, None), (3, ""), (4, "! ?"), (7, "One  line"), (1, "beta gamma delta epsilon zeta eta")], "item_id long, text string")


def operators(labels, items):
    return {
        "toxicity": lambda d: toxicity.find(d, toxicity.fit(d, labels)),
        "simhash": simhash.groups,
        "simhash_keep": simhash.deduplicate,
        "crossparse": lambda d: crossparse.relative_entropy(d, labels),
        "pfair": pfair.mix,
        "sanitise": sanitize.sanitise,
        "leaks": lambda d: containment.leaks(d, items),
        "decontaminate": lambda d: containment.decontaminate(d, items),
        "quality": quality.keep_good,
        "bitmaps": linededup.bitmaps,
        "lines": linededup.deduplicate_lines,
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(docs, clashing, labels, items, name):
    op = operators(labels, items)[name]
    plain, extra = op(docs), op(clashing)
    rows = sorted(map(repr, plain.collect()))
    assert sorted(map(repr, extra.select(plain.columns).collect())) == rows
    if name in ("simhash_keep", "decontaminate", "quality", "lines"):
        assert extra.columns == clashing.columns


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, items, name):
    assert operators(labels, items)[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "crossparse", "leaks", "decontaminate"])
def test_empty_side_table(docs, labels, items, name):
    got = operators(labels.where("false"), items.where("false"))[name](docs)
    assert got.count() == {"toxicity": 0, "crossparse": len(ROWS), "leaks": 0, "decontaminate": len(ROWS)}[name]


def test_results_of_awkward_rows(docs, labels, items):
    ops = operators(labels, items)
    got = {(r.doc_id, r.keep_id, r.group_size, r.distance) for r in ops["simhash"](docs).collect()}
    assert got == {(1, 1, 2, 0), (None, None, 2, 0)}
    assert ops["simhash_keep"](docs).count() == len(ROWS) - 2
    assert sorted((r.doc_id, r.item_id) for r in ops["leaks"](docs).collect()) == [(1, 1)] * 4 + [(6, 7)]
    assert ops["decontaminate"](docs).count() == len(ROWS) - 3
    maps = {(r.doc_id, r.n_lines): (r.n_kept, r.keep) for r in ops["bitmaps"](docs).collect()}
    assert maps[6, 3] == (2, "1,1,1") and maps[5, 4] == (4, "4") and maps[3, 1] == (1, "1")
    lines = {(r.doc_id, r.text) for r in ops["lines"](docs).collect()}
    assert (6, "one line\ntwo") in lines and (2, None) in lines and (3, "") in lines
    assert {r.text for r in ops["sanitise"](docs).collect() if r.doc_id is None} == {"a text of nobody [IP]"}
    mixed = ops["pfair"](docs).collect()
    assert len(mixed) == len(ROWS) and len({r.place for r in mixed}) == len(ROWS)


def test_awkward_pages(spark):
    pages = spark.createDataFrame([(1, "u", "ab" * 20_000), (1, "u", "ab" * 20_000), (2, None, ""), (None, "v", None)], "page_id long, url string, html string").withColumn("b", F.lit(1)).withColumn("chunk_no", F.lit(9))
    rows = warc.chunk_pages(pages).collect()
    assert sorted((r.page_id or 0, r.chunk_no, r.n_bytes, r.is_last) for r in rows) == sorted([(1, 0, 16384, False), (1, 1, 16384, False), (1, 2, 7232, True)] * 2 + [(2, 0, 0, True), (0, 0, None, True)])
    assert warc.chunk_pages(pages.where("false")).count() == 0


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 1, "assistant", "y " * 50_000), (2, 0, "system", "")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = chat.format_spans(talks)
    assert got.count() == len(rows) * len(chat.TEMPLATES)
    assert chat.format_spans(talks.where("false")).count() == 0


def test_stages_on_awkward_rows(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) < set(out.columns) and out.count() > 3
