"""Mixing: targets against a step-by-step version, rounding by what it promises."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string, source string"


def brute_targets(sizes, cap=3.0):
    """Share by weight, stop at the cap, share what is left, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] > cap * sizes[s]]
        if not above:
            return {**full, **{s: level * weight[s] for s in rest}}
        full.update({s: cap * sizes[s] for s in above})


def check(rows, docs):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    count = defaultdict(int)
    for d, t, s in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        count[(d, s, n)] += 1
    want = brute_targets(sizes)
    got = defaultdict(int)
    for r in rows:
        got[(r.doc_id, r.source, r.size)] += 1
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert got == count
    for _, s, n in count:
        largest[s] = max(largest[s], n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s
    return taken


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = mixing.mix_table(docs).collect()
    check(first, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    again = mixing.mix_table(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_levels_ties_and_nulls(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", "B", None, "hot", "hot", "hot"])) for i in range(700)]
    docs += [(i, "x y z", "tiny") for i in (1, 1, 2)] + [(None, "a b", "b"), (None, "a b", "b"), (None, None, "b"), (9, "", None), (10, None, "empty")]
    frame = spark.createDataFrame(docs, SCHEMA)
    check(mixing.mix_table(frame).collect(), docs)


def test_shares_are_unbiased(spark):
    docs = [(i, "w " * (i % 7 + 1), "a" if i % 4 else "b") for i in range(120)]
    frame = spark.createDataFrame(docs, SCHEMA).cache()
    runs, total = 12, defaultdict(float)
    for seed in range(runs):
        for r in mixing.mix_table(frame, seed=seed * 10).collect():
            total[(r.source, r.doc_id % 3)] += r.taken / r.size / runs
    sizes = defaultdict(int)
    for d, _, s in docs:
        sizes[s] += d % 7 + 1
    want = brute_targets(sizes)
    for (s, k), copies in total.items():
        members = [d for d, _, x in docs if x == s and d % 3 == k]
        assert copies / len(members) == pytest.approx(want[s] / sizes[s], abs=0.12)


def test_mix_keeps_documents(spark, corner_dir):
    docs = spark.read.parquet(f"{corner_dir}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copies"]
    table = sorted(str((r.doc_id, r.source, r.size, r.copies)) for r in mixing.mix_table(docs).collect() if r.copies)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(str((r.doc_id, r.source, size(r.text), r.copies)) for r in out.collect()) == table


def test_repeated_rows_meet_their_target(spark, monkeypatch):
    """A source of 50 equal rows, one with equal rows without id, and columns with the names used inside."""
    monkeypatch.setattr(mixing, "ROWS_PER_GROUP", 4)
    docs = [(1, "ten words are in here as any reader can count", "a")] * 50 + [(i, "w " * 10, "b") for i in range(70)] + [(None, "x y z", "c")] * 33
    frame = spark.createDataFrame(docs, SCHEMA)
    taken = check(mixing.mix_table(frame).collect(), docs)
    assert 0 < taken["a"] < 500
    for name in ("_mix_copies", "mix_unit", "mix_row", "mix_each", "unit", "row", "copies"):
        frame = frame.withColumn(name, F.lit("own"))
    out = mixing.mix(frame)
    assert out.columns == [c for c in frame.columns if c != "copies"] + ["copies"]
    rows = out.collect()
    assert {r.mix_unit for r in rows} == {"own"} and all(1 <= r.copies <= 3 for r in rows)
    size = {"a": 10, "b": 10, "c": 3}
    assert {s: sum(r.copies * size[s] for r in rows if r.source == s) for s in size} == dict(taken)
