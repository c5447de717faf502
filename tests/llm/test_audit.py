"""The contractions against filters that really run one after the other."""

import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import audit


def simulated(members):
    """By order and step: kept, removed, redundant, unique fails, good lost, toxic lost."""
    out = {}
    for order in permutations(range(5)):
        alive = list(members)
        for step, own in enumerate(order):
            gone = [m for m in alive if m[0] >> own & 1]
            failing = [m for m in members if m[0] >> own & 1]
            alive = [m for m in alive if not m[0] >> own & 1]
            alone = sum(m[0] == 1 << own for m in members)
            out["".join("ABCDE"[k] for k in order), step + 1] = (len(alive), len(gone), len(failing) - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone))
    return out


def test_contractions_are_the_filters_in_a_row():
    rng = random.Random(5)
    members = [(rng.randrange(32), rng.randrange(2), rng.randrange(2)) for _ in range(300)]
    counts = {b: [sum(m[0] == b for m in members), sum(m[0] == b and m[1] for m in members), sum(m[0] == b and m[2] for m in members)] for b in range(32)}
    cells = pa.table({"part": ["x"] * 32, "bits": pa.array(list(counts), pa.int32()), **{n: [c[i] for c in counts.values()] for i, n in enumerate(("n", "good", "toxic"))}})
    got, want = audit._audited(cells).to_pylist(), simulated(members)
    assert len(got) == 600
    for row in got:
        assert tuple(row[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == want[row["filter_order"], row["step"]]
    for own in "ABCDE":
        total = sum(v[1] for (order, step), v in want.items() if order[step - 1] == own)
        assert {r["shapley"] for r in got if r["filter_order"][r["step"] - 1] == own} == {total}
    # What the filters remove in all orders together is what fails any of them, 120 times.
    shares = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}
    assert sum(shares.values()) == 120 * sum(m[0] > 0 for m in members)


def test_selectors_cover_every_order_once():
    chosen = audit.selectors()
    assert all(v.shape == (600, 5, 2) for v in chosen.values())
    ones = np.ones((3, 2, 2, 2, 2, 2), dtype=np.int64)
    assert set(audit.contracted(ones, chosen["alone"]).reshape(-1)) == {1}


@pytest.mark.parametrize(("text", "bits"), [("", 1), ("a b", 1), (" ".join(f"w{i}" for i in range(200)), 0), ("w " * 200, 2), ("A " * 10, 1 | 2 | 4), ("#", 1 | 8), ("é" * 97 + "A" * 3, 1), ("é" * 96 + "A" * 4, 1 | 4)])
def test_failure_bits(text, bits):
    assert audit.failure_bits(text.encode(), len(text)) == bits


def test_copies_labels_and_nulls(spark):
    docs = spark.createDataFrame(
        [(5, "same", "x"), (3, "same", "y"), (3, "same", "y"), (9, "same", "x"), (None, "same", "x"), (None, "same", None), (7, None, ""), (8, "", None)],
        "doc_id int, text string, lang string",
    ).withColumn("bits", docs_column(1)).withColumn("digest", docs_column("a")).withColumn("n", docs_column(7))
    labels = spark.createDataFrame([(9, 1, None, "z"), (9, 0, 1, "z"), (None, 1, 1, "z"), (3, None, None, "z")], "doc_id bigint, quality int, toxic int, part string")
    found = {(r.part, r.bits): (r.n, r.good, r.toxic) for r in audit.cells(docs, labels).where("n > 0").collect()}
    # Ids 5 and 9 are copies of 3, whose two rows are not; the rows without id copy nobody.
    assert found == {("x", 17): (2, 1, 1), ("y", 1): (2, 0, 0), ("x", 1): (1, 0, 0), ("", 1): (2, 0, 0), ("", 17): (1, 0, 0)}
    rows = audit.audit(docs, labels).collect()
    assert {r.part for r in rows} == {"", "x", "y"} and len(rows) == 3 * 600


def docs_column(value):
    from pyspark.sql import functions as F

    return F.lit(value)
