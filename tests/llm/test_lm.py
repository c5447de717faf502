"""Language-model scores: the unigram base against brute force, the model on held-out documents."""

import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from assayer.llm import lm
from assayer.llm.blocks import _BLOCK, blocks_of
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string"


def brute(docs):
    cut = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    counts = Counter(w for d, t in docs if not held(d) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        tokens = cut(t)
        out.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return out


def compare(got, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted([tuple(r) for r in got], key=key), sorted(brute(docs), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    return got


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = compare(lm.score(docs).collect(), rows)
    held = [g for g in got if g[1]]
    assert len(held) > 50
    assert sum(g[6] for g in held) > sum(g[5] for g in held) * 0.97  # better than the unigram base on unseen texts


def test_corner_cases(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "Ä ä A a " * 5000), (3, "x\x0by z"), (4, "a"), (4, "a"), (5, "b")]
    compare(lm.score(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    extra = spark.createDataFrame([(1, "a", 2, 3)], SCHEMA + ", block int, score int")
    compare(lm.score(extra).collect(), [(1, "a")])
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_probabilities_sum_to_one():
    heads = [(b"h%d" % i, 50 - i % 40) for i in range(lm.HEADS - 1)] + [(b"", 9)]
    tails = {b"w%d" % i: i % 5 + 1 for i in range(400)}
    sums = [0] * (2 * lm.TAIL_CLASSES)
    for w, c in [*heads, *tails.items()]:
        sums[lm.tail_class(w)] += c
        sums[lm.TAIL_CLASSES + lm.tail_class(w)] += 1
    model = lm.Model.of_counts(heads, sums)
    rng = np.random.default_rng(1)
    model.class_weights += rng.normal(size=model.class_weights.shape).astype(np.float32)
    model.head_weights += rng.normal(size=model.head_weights.shape).astype(np.float32)
    known = {**dict(heads), **tails}
    total = 0.0
    for w, c in known.items():
        t = lm.tokens_of([1], [b"h3 " + w])
        counts = np.array([known.get(x, 0) for x in t.vocabulary])
        total += 10 ** lm.log10_of(model, t, counts)[1]
    # What is left is one unseen word per tail class.
    assert total == pytest.approx(1.0, abs=0.02) and total < 1


def test_sizes_grow_with_the_vocabulary():
    small, large = lm.Shape.of(400), lm.Shape.of(5_000_000)
    assert small.heads == 512 and small.table == 1 << 14
    assert large.heads > 2000 and large.table > small.table and large.tail_depth > small.tail_depth


def test_trigrams_and_contexts_of_tail_words_are_learned():
    """After "x a" comes t1, after "y a" comes t2; both are tail words with one ending, and only both words before tell which."""
    assert lm.features(lm.tokens_of([1], [b"x a t"])).shape[1] == 3
    words = [b"t%dzz" % i for i in range(64)]
    shape = lm.Shape(1, 1)
    first, second = next((a, b) for a in words for b in words if lm.buckets_of([a], shape) != lm.buckets_of([b], shape))
    known = {b"": 1, b"x": 400, b"y": 400, b"a": 800}
    tails = {first: 400, second: 400}
    tokens, types = np.zeros((2, lm.TAIL_CLASSES * lm.WIDTH))
    for w, c in {**known, **tails}.items():
        np.add.at(tokens, lm.buckets_of([w], shape), c)
        np.add.at(types, lm.buckets_of([w], shape), 1)
    model = lm.Model.of_counts(list(known.items()), np.concatenate([tokens, types]), shape)
    text = (b"x a " + first + b" y a " + second + b" ") * 400
    t = lm.tokens_of([1], [text])
    classes, nodes, branches, _ = lm._places(model, t)
    h, used = lm.features(t), np.zeros(lm.TABLE)
    for _ in range(40):
        lm._learn(model.class_bias, model.class_weights, used, lm._rows(h, lm.TABLE), classes[t.numbers])
        inner = np.flatnonzero(nodes[0][t.numbers] >= 0)
        node = nodes[0][t.numbers[inner]]
        lm._learn(model.inner_bias[node], model.head_weights, used, lm._rows(h[inner], lm.TABLE, node), branches[0][t.numbers[inner]])
    counts = lambda t: np.array([{**known, **tails}.get(w, 0) for w in t.vocabulary])
    score = lambda text: lm.log10_of(model, u := lm.tokens_of([1], [text]), counts(u))[2]
    assert score(b"x a " + first) > score(b"y a " + first) + 0.5
    assert score(b"y a " + second) > score(b"x a " + second) + 0.5


def test_step_and_scores_against_the_plain_formula():
    """Steps that stay in the cache, and sums by branch, change nothing: more tokens than a step, rows used many times."""
    rng = np.random.default_rng(4)
    n, table = lm.STEP + 77, 64
    weights, bias = rng.normal(size=(table, lm.WIDTH)).astype(np.float32), rng.normal(size=(n, lm.WIDTH)).astype(np.float32)
    rows, target, used = rng.integers(0, table // 2, (n, 3)), rng.integers(0, lm.WIDTH, n), np.zeros(table, np.float32)
    logits = bias + weights.astype(np.float64)[rows].sum(axis=1)
    share = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(lm._log_of(bias, weights, rows, target), np.log(share[np.arange(n), target]), atol=1e-5)
    slope = share - np.eye(lm.WIDTH)[target]
    moved, times = np.zeros((table, lm.WIDTH)), np.bincount(rows.reshape(-1), minlength=table)
    np.add.at(moved, rows.reshape(-1), np.repeat(slope, 3, axis=0))
    after = weights - (lm.RATE / (0.25 * times + 1))[:, None] * moved
    lm._learn(bias, weights, used, rows, target)
    assert np.allclose(weights, after, atol=1e-4) and (used == times).all()


def test_texts_are_split_once_per_block(monkeypatch):
    """Counting, learning and scoring read the tokens written with the block."""
    texts, ids = [b"A b\x0bc  a", b"", b"\xc3\x84 x\x00y b\n", b" b a b"], [1, 2, None, 4]
    whole = lm.tokens_of(ids, texts)
    block = pa.record_batch([pa.array(c, f.type) for c, f in zip(([7], [ids], *([x] for x in lm._write(texts))), _BLOCK, strict=True)], schema=_BLOCK)
    model = lm.Model.of_counts([(b"b", 4), (b"a", 3), (b"", 4)], np.ones(2 * lm.TAIL_CLASSES) * 9)

    def again(*_):
        raise AssertionError("split again")

    monkeypatch.setattr(lm, "_split", again)
    monkeypatch.setattr(lm, "tokens_of", again)
    sent = pa.Table.from_batches(list(lm._sent(iter([block]), 2)))
    answers = pa.concat_tables([lm._summed(sent.filter(pc.equal(sent.column("shard"), s))) for s in (0, 1)])
    assert sum(np.frombuffer(x, np.int64).sum() for x in answers.column("counts").to_pylist()) == whole.lengths[whole.training].sum()
    assert sum(b.num_rows for b in lm._trained(iter([block]), model)) > 0
    ((_, _, split),) = blocks_of([block], lm._read)
    scored = lm._scored(SimpleNamespace(value=model), 2)(7, ids, split, answers)
    assert scored.column("n_tokens").to_pylist() == whole.lengths.tolist()


@pytest.mark.parametrize("spread", [1, 40])
def test_step_with_rows_used_once_several_times_and_often(spread):
    """All three ways to sum give the plain formula, also where exp of the logits would overflow."""
    rng = np.random.default_rng(5)
    n, table = lm.STEP * 2 + 5, 1 << 14
    uses = [300, *range(2, 2 * lm.OFTEN)]
    uses += [1] * (3 * n - sum(uses))
    rows = rng.permutation(np.repeat(rng.permutation(table)[: len(uses)], uses)).reshape(n, 3)
    times = np.bincount(rows.reshape(-1), minlength=table)
    weights, bias = (spread * rng.normal(size=(table, lm.WIDTH))).astype(np.float32), rng.normal(size=lm.WIDTH).astype(np.float32)
    target, used = rng.integers(0, lm.WIDTH, n), np.ones(table, np.float32)
    logits = bias + weights.astype(np.float64)[rows].sum(axis=1)
    assert (np.abs(logits).max() > lm.SAFE) == (spread > 1)
    logits -= logits.max(axis=1, keepdims=True)
    share = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(lm._log_of(bias, weights, rows, target), logits[np.arange(n), target] - np.log(np.exp(logits).sum(axis=1)), atol=1e-5 * spread)
    moved = np.zeros((table, lm.WIDTH))
    np.add.at(moved, rows.reshape(-1), np.repeat(share - np.eye(lm.WIDTH)[target], 3, axis=0))
    after = weights - (lm.RATE / (0.25 * times + 1))[:, None] * moved
    lm._learn(bias, weights, used, rows, target)
    assert np.allclose(weights, after, atol=1e-4) and (used == times + 1).all()


def test_sums_of_a_shard(monkeypatch):
    """Counts for every block, the most frequent words by count, then by bytes; words of no training count are no heads."""
    monkeypatch.setattr(lm, "NAMED", 3)
    messages = [([b"b", b"", b"\xff"], [2, 5, 0]), ([b"\xfe", b"b", b"a"], [2, 1, 2])]
    pack = lambda words: zstandard.ZstdCompressor().compress(b"\n".join(words))
    columns = ([9, 9], [1, 2], [pack(w) for w, _ in messages], [np.array(c, np.int32).tobytes() for _, c in messages])
    got = lm._summed(pa.table([pa.array(c, f.type) for c, f in zip(columns, lm._MESSAGE, strict=True)], schema=lm._MESSAGE)).to_pylist()
    assert [np.frombuffer(r["counts"], np.int64).tolist() for r in got] == [[3, 5, 0], [2, 3, 2]]
    assert [(h["word"], h["n"]) for h in got[0]["heads"]] == [(b"", 5), (b"b", 3), (b"a", 2)] and got[1]["heads"] is None
    assert np.frombuffer(got[0]["totals"], np.int64).reshape(-1, 2)[:, 1].sum() == 12
