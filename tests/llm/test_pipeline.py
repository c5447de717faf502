"""The stages one by one against brute force, and the whole run."""


import pytest

import corpus_pipeline
from assayer.llm import decontaminate, quality, secrets
from assayer.llm.text import kept
from tests.conftest import SMALL
from tests.llm.test_near import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("which", ["given", "corner"])
def test_stages(spark, which, corner_dir):
    folder = SMALL if which == "given" else corner_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = kept(stages["quality"](spark, docs, folder), "t")
    assert good.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in quality.measure(docs).collect() if r.doc_id is not None}
    assert {r.doc_id for r in good.collect()} - {None} == {d for d, k in verdicts.items() if k}

    unique = kept(stages["near_duplicates"](spark, good, folder), "t")
    assert unique.columns == docs.columns
    classes = brute([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in unique.collect()} - {None} == {c for d, c, _ in classes if d is not None and d == c}

    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    clean = kept(stages["decontaminate"](spark, unique, folder), "t")
    hit = {r.doc_id for r in decontaminate.report(unique, benchmark).where("n_hit > 0").collect()}
    assert rows(clean) == [r for r in rows(unique) if r[0] not in hit]

    safe = kept(stages["secrets"](spark, clean, folder), "t")
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert secrets.scan(safe).where("size(secret_spans) > 0").count() == 0
    before = {(r.doc_id, r.text) for r in secrets.scan(clean).where("size(secret_spans) = 0").collect()}
    assert before <= {(r.doc_id, r.text) for r in safe.collect()}
    assert all(r.n_chars == len(r.text) for r in safe.collect())

    mixed = stages["mix"](spark, safe, folder)
    assert mixed.columns == [*docs.columns, "copies"]
    assert all(1 <= r.copies <= 3 for r in mixed.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() < 200 and out.columns == [*COLUMNS, "copies"]


def test_spans_removed(spark):
    """With spans instead of documents only the words that were hit go."""
    docs = spark.createDataFrame([(1, "keep, One two THREE four? then one two"), (2, "nothing here"), (None, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(docs, benchmark, "spans").collect()}
    assert got == {1: "keep, then one two", 2: "nothing here", None: None}


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(decontaminate.report(docs, benchmark, block=97)) == key(decontaminate.report(docs, benchmark))


def test_order_of_rules_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    every = quality.BASE + quality.RULES
    ids = lambda rules: {r.doc_id for r in docs.where(quality.cascade(rules, quality.Measures.of_text(docs.text)).isNull()).collect()}
    assert ids(every) == ids(every[::-1]) == {r.doc_id for r in quality.measure(docs).where("kept").collect()}
    estimates = quality.estimate(docs, every)
    assert [e.name for e in estimates] == [r.name for r in every] and any(e.rejected > 0 for e in estimates)


