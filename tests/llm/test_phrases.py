"""Phrase dedup against a brute-force version."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import phrases
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string"


def brute(docs, size=phrases.SIZE):
    order = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    key = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            order[g] = min(order.get(g, float("inf")), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if order[tuple(w[i : i + size])] < key(d):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[3]))


@pytest.fixture
def made():
    random.seed(5)
    word = lambda: random.choice(["a", "b", "été", "Ünd", "of", "the", "x.", "日本"]) + str(random.randrange(40))
    passages = [[word() for _ in range(n)] for n in (13, 14, 40, 90)]
    docs = []
    for i in range(80):
        text = [word() for _ in range(random.randrange(0, 60))]
        for p in random.sample(passages, random.randrange(0, 3)):
            cut = random.randrange(0, 5)
            text += p[cut:] + [word()]
        docs.append((i * 7 % 83, (" " if i % 3 else "\n\t").join(text)))
    docs += [(None, docs[3][1]), (None, docs[3][1]), (500, docs[4][1]), (500, docs[4][1]), (501, None), (502, ""), (-3, docs[5][1])]
    docs.append((600, "over and " * 4000))
    return docs


def test_equals_brute_force(spark, made, monkeypatch):
    frame = spark.createDataFrame(made, SCHEMA).repartition(3)
    packed = phrases.pack(frame, 700)
    assert packed.count() > 10
    monkeypatch.setattr(phrases, "pack", lambda docs: packed)
    got = phrases.dedup(frame, phrases=50).collect()
    assert ordered(got) == ordered(brute(made))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 1000
    assert ordered(phrases.dedup(docs).collect()) == ordered(want)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", block bigint, shard int, n_words string")
    assert phrases.dedup(empty).collect() == []
    one = spark.createDataFrame([(1, "a b", 3, 4, "x")], SCHEMA + ", block bigint, shard int, n_words string")
    assert [tuple(r) for r in phrases.dedup(one).collect()] == [(1, 2, 0, "a b")]


def hot_documents(n=60):
    """A common run of words with other words around it; every third document repeats an earlier one's surroundings."""
    around = [[f"a{i}x{j}" for j in range(16)] for i in range(n)]
    return [(i, " ".join(around[i - 2 * (i % 3 == 2)][:8] + "these five words come often".split() + around[i - 2 * (i % 3 == 2)][8:])) for i in range(n)]


def test_hot_anchor_equals_brute_force(spark, monkeypatch):
    docs = hot_documents()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    packed = phrases.pack(frame, 700)
    monkeypatch.setattr(phrases, "pack", lambda docs: packed)
    want = brute(docs)
    assert sum(r[2] for r in want) > 300
    assert ordered(phrases.dedup(frame, phrases=5).collect()) == ordered(want)


def test_hot_anchor_is_split():
    texts = [t.encode() for _, t in hot_documents()]
    w, shards = phrases.windows_of(list(range(60)), texts), 64
    hot = {s: np.packbits(np.ones(2 * len(at), dtype=bool)).tobytes() for s, at in phrases._by_shard(np.unique(w.anchors), shards)}
    sent = list(phrases._recurring(w, hot, shards))
    assert sum(len(runs) for _, runs, _ in sent) == len(w.fresh)
    assert max(len(runs) for _, runs, _ in sent) < len(w.fresh) / 10  # no group has more than its share
    assert all((runs[:, 1] - runs[:, 0] == 1).all() for _, runs, _ in sent)


def test_anchor_with_many_windows_is_hot():
    sent = np.array([[1] * 6 + [9], [2] * 6 + [1]], dtype=np.uint8).tobytes()
    table = pa.table([pa.array([0, 0], pa.int32()), pa.array([1, 2], pa.int64()), pa.array([sent, sent], pa.binary())], schema=phrases._SENT)
    for bits in phrases._met(table, 10).column("bits").to_pylist():
        assert phrases._flags(bits, 4).tolist() == [True, True, True, False]
