"""Filter interaction audit: what each filter removes in every order of the filters, from contingency tensors.

Every document is reduced to five failure bits. Per part (a language) the documents are counted by their
bits, which gives a 2 x 2 x 2 x 2 x 2 tensor, with a layer each for all, good and toxic documents. Every
figure of every order is then a contraction of that tensor: along each axis the vector (1, 0) selects
those that pass a filter, (0, 1) those that fail and (1, 1) all.

The last filter, copies, asks whether a smaller doc_id has the same text anywhere in the table. Rows are
collapsed by text digest, part and label before the copies of a text meet, so a text that is a third of
all rows is a few rows there.

NULL texts are empty; an empty text fails the length filter and is a copy like any other. A NULL part is
the empty string. Rows without doc_id are no copies, have no labels and hide nobody's. Of repeated rows
with the smallest id none is a copy. Where ``labels`` repeats an id, one row with the value suffices.
Texts are read whole. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.text import UPPER, kept

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Bit of the copies filter, which is set where the copies of a text meet.
COPY = 1 << 4
LIGHT = "part string, doc_id bigint, digest binary, bits int"
_LIGHT = pa.schema([("part", pa.string()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("bits", pa.int32())])
AUDIT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def failure_bits(text: bytes, chars: int) -> int:
    """Bits 0 to 3 for the filters A to D on a whole text in UTF-8 of ``chars`` code points."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER.encode()))
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * upper > MOST_UPPER * chars, symbols > 0)
    return sum(1 << k for k, f in enumerate(failed) if f)


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, bits = [], []
        lengths = pc.utf8_length(batch.column(2)).to_pylist()
        for text, chars in zip(batch.column(2), lengths, strict=True):
            body = text.as_buffer().to_pybytes()
            digests.append(hashlib.sha256(body).digest())
            bits.append(failure_bits(body, chars))
        columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, schema=_LIGHT)


def selectors(count: int = len(FILTERS)) -> dict[str, np.ndarray]:
    """Per order, step and axis the vector that contracts the axis: arrays (orders * steps, axes, 2) by figure."""
    chosen: dict[str, list] = {"kept": [], "removed": [], "failing": [], "alone": []}
    for order in permutations(range(count)):
        for step, own in enumerate(order):
            before = order[:step]
            chosen["kept"].append([PASS if k in before or k == own else ALL for k in range(count)])
            chosen["removed"].append([FAIL if k == own else PASS if k in before else ALL for k in range(count)])
            chosen["failing"].append([FAIL if k == own else ALL for k in range(count)])
            chosen["alone"].append([FAIL if k == own else PASS for k in range(count)])
    return {name: np.array(vectors, dtype=np.int64) for name, vectors in chosen.items()}


def contracted(tensor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(steps, layers): the tensor (layers, 2, 2, 2, 2, 2) contracted along every axis for every step."""
    axes = [vectors[:, k] for k in range(len(FILTERS))]
    return np.einsum("labcde,sa,sb,sc,sd,se->sl", tensor, *axes, optimize=True)


def _audited(cells: pa.Table) -> pa.Table:
    """All orders and steps of one part, from its at most 32 cells."""
    tensor = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
    at = cells.column("bits").to_numpy()
    for layer, name in enumerate(("n", "good", "toxic")):
        np.add.at(tensor[layer], at, cells.column(name).to_numpy())
    # Bit k is axis k: the bits, lowest first, are the axes in reverse.
    tensor = tensor.reshape(3, *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
    figures = {name: contracted(tensor, vectors) for name, vectors in selectors().items()}
    orders = list(permutations(range(len(FILTERS))))
    own = np.array(orders).reshape(-1)
    shapley = np.bincount(own, weights=figures["removed"][:, 0], minlength=len(FILTERS)).astype(np.int64)
    steps = len(own)
    return pa.table(
        {
            "part": pa.array([cells.column("part")[0].as_py()] * steps, pa.string()),
            "filter_order": pa.array(["".join(FILTERS[k] for k in order) for order in orders for _ in order]),
            "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(orders)), pa.int32()),
            "kept": figures["kept"][:, 0],
            "removed": figures["removed"][:, 0],
            "redundant": figures["failing"][:, 0] - figures["removed"][:, 0],
            "unique_fails": figures["alone"][:, 0],
            "good_lost": figures["removed"][:, 1],
            "toxic_lost": figures["removed"][:, 2],
            "shapley": shapley[own],
        }
    )


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Counts by part and failure bits: part, bits, n, good, toxic. At most 32 rows a part."""
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Written, as rows with and without an id go different ways and the texts are to be read once.
    light = kept(rows.mapInArrow(_light, LIGHT).groupBy("digest", "bits", "part", "doc_id").agg(F.count(F.lit(1)).alias("n")), "audit-light")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    named = light.where("doc_id is not null").join(known, "doc_id", "left")
    named = named.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    # An id stands once in a group, so the smallest comes with the number of its rows.
    grouped = named.groupBy("digest", "bits", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    met = grouped.withColumn("originals", F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
    both = F.array(
        F.struct(F.col("bits").alias("bits"), F.col("originals").cast("bigint").alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(COPY)).alias("bits"), (F.col("n") - F.col("originals")).cast("bigint").alias("n")),
    )
    split = met.select("part", "good", "toxic", F.explode(both).alias("cell")).select("part", "cell.bits", "cell.n", "good", "toxic")
    nameless = light.where("doc_id is null").select("part", "bits", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    among = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(c)
    return split.unionByName(nameless).groupBy("part", "bits").agg(F.sum("n").cast("bigint").alias("n"), among("good"), among("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps, removes and costs."""
    return cells(docs, labels, part).groupBy("part").applyInArrow(_audited, AUDIT)
