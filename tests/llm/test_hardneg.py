"""Hard negatives: intervals that hold every score, blocks that agree with brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import hardneg


def vectors(seed, n, dims, scale=100):
    return np.random.default_rng(seed).integers(-scale, scale, size=(n, dims))


def bounds(rows, anchors, turn, centres):
    return hardneg.intervals(*hardneg.encoded(rows, turn, centres), hardneg.rounded(anchors, turn), anchors @ centres.T, len(turn))


@pytest.mark.parametrize("count", [1, 8])
@pytest.mark.parametrize("dims", [1, 3, 64, 100, 130])
def test_intervals_hold_every_score(dims, count):
    rows, anchors = vectors(1, 200, dims), vectors(2, 30, dims)
    rows[0] = 0
    rows[1] = anchors[0]
    rows[2] = 1
    turn, centres = hardneg.rotation(dims), hardneg.fitted(rows[:50], dims, count)
    lower, upper = bounds(rows, anchors, turn, centres)
    exact = anchors @ rows.T
    assert (lower <= exact).all() and (exact <= upper).all()
    # They say more than the product of the lengths does.
    widest = 2 * np.linalg.norm(anchors, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    assert (upper - lower).sum() < 0.9 * widest.sum()


def test_intervals_leave_out_rows_far_away():
    """On vectors in clusters most of the rows cannot be among the best."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64))
    rows = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + 0.05 * rng.standard_normal((4000, 64)))).astype(np.int64)
    turn, centres = hardneg.rotation(64), hardneg.fitted(rows[:500], 64)
    lower, upper = bounds(rows, rows[:10], turn, centres)
    best = np.sort(lower, axis=1)[:, -5]
    assert (upper >= best[:, None]).mean() < 0.3


def test_scores_beyond_doubles_and_longs():
    big = np.array([[2**62, 2**62], [3, -1], [-(2**62), 0]])
    got = hardneg.scores(big, big)
    assert got[0].tolist() == [2**63 - 1, 2**63 - 1, -(2**63)] and got[1].tolist() == [2**63 - 1, 10, -(2**63)]
    exact = vectors(4, 5, 7, 2**30)
    assert (hardneg.scores(exact, exact) == exact @ exact.T).all()


def test_band_without_overflow():
    score, positive = np.array([80, 79, 100, 101, 2**62, 0, -5]), np.array([100, 100, 100, 100, 2**62, 0, -5])
    assert hardneg._in_band(score, positive, 80, 100).tolist() == [True, False, True, False, True, True, False]


def brute(rows, positives=5, negatives=5, low=80, high=100):
    """Rows (id, label, vector) to the answer, one anchor after the other."""
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (anchor, label, vector) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v, strict=False)), other, lab) for j, (other, lab, v) in enumerate(rows) if j != i]
        for p_score, p_id, _ in sorted([s for s in scored if s[2] == label], key=order)[:positives]:
            banded = [s for s in scored if s[2] != label and low * p_score <= 100 * s[0] <= high * p_score]
            out += [(anchor, p_id, k + 1, n_id, p_score, n_score) for k, (n_score, n_id, _) in enumerate(sorted(banded, key=order)[:negatives])]
    return sorted(out, key=str)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(hardneg, "ANCHORS_PER_BLOCK", 3)
    monkeypatch.setattr(hardneg, "BLOCKS_PER_GROUP", 2)
    rng = random.Random(6)
    rows = [(rng.choice([i, i * 20, i * 100, None]) if i % 5 == 0 else i, rng.randrange(3), [rng.randrange(-3, 4) for _ in range(rng.choice([6, 6, 3]))]) for i in range(150)]
    rows += rows[:20]  # ties and repeated anchors
    frame = spark.createDataFrame([(i, lab, [x / 256 for x in v], "x") for i, lab, v in rows], "vec_id bigint, label int, embedding array<double>, block string").repartition(6)
    found = hardneg.mine(frame, F.col("id") % 100 == 0)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=str)
    want = brute(rows)
    assert len({r[0] for r in want}) > 3 and got == want


def test_other_counts_and_bands(spark):
    rows = [(i, i % 2, [int(x) for x in v]) for i, v in enumerate(vectors(9, 90, 5, 50))]
    frame = spark.createDataFrame([(i, lab, [x / 256 for x in v]) for i, lab, v in rows], "vec_id int, label int, embedding array<double>")
    got = hardneg.mine(frame, F.col("id") % 100 == 0, positives=2, negatives=3, low=10, high=150)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(rows, 2, 3, 10, 150)
