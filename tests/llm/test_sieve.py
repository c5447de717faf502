"""Rows that need no look-up stay where they are, whatever Spark may broadcast."""

import random

from pyspark.sql import functions as F

from assayer.llm import decontaminate, mixing, near
from assayer.llm.text import sieved


def moved(df) -> tuple[list, int]:
    """The rows of a result, and how many rows that hold a text its plan shuffled."""
    rows = df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and "text#" in node.output().mkString():
                total += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return rows, total


def test_sieve_loses_no_key(spark):
    keys = spark.range(2000).select(F.xxhash64("id"))
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else i) for i in range(20_000)], "id bigint, sieve_key bigint")
    for most, others in ((1 << 20, 0.03), (16, 1.0)):
        out = sieved(rows, F.xxhash64("id"), keys, "mark", most).collect()
        assert sorted(r.id for r in out) == list(range(20_000)) and out[0].asDict().keys() == {"id", "sieve_key", "mark"}
        assert all(r.mark for r in out if r.id < 2000)
        assert sum(r.mark for r in out) <= 2000 + 18_000 * others
    assert not any(r.mark for r in sieved(rows, F.xxhash64("id"), keys.limit(0), "mark").collect())


def test_stages_move_few_texts(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    item = some(12)
    texts = [some(30) for _ in range(600)]
    texts += [f"{some(5)} {item} {some(5)}" for _ in range(20)] + texts[:20]
    docs = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in enumerate(texts)] + [(None, "x " * 30, None)], "doc_id bigint, text string, source string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        clean, n_clean = moved(decontaminate.clean(docs, benchmark))
        spans, n_spans = moved(decontaminate.clean(docs, benchmark, remove="spans"))
        unique, n_unique = moved(near.keep_one(docs))
        mixed, n_mixed = moved(mixing.mix(docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    everything = [*range(640), None]
    assert ids(clean) == sorted([i for i in everything if i not in range(600, 620)], key=str)
    assert ids(spans) == sorted(everything, key=str) and sum(item.split()[0] + " " in r.text and item in r.text for r in spans) == 0
    assert ids(unique) == sorted([i for i in everything if i not in range(620, 640)], key=str)
    planned = {r.doc_id: r.copies for r in mixing.mix_table(docs).collect()}
    assert {r.doc_id: r.copies for r in mixed} == {d: c for d, c in planned.items() if c}
    assert max(n_clean, n_spans, n_unique, n_mixed) < 100
