"""Hard negatives for anchor vectors, by rotated one-bit codes with exact intervals and integer scores.

Vectors are integers: floor(SCALE * x) per component. The score of two rows is their inner product, and
higher scores come first, ties by smaller id, rows without id last. An anchor's positives are its best
other rows of the same label; its hard negatives for a positive are the best rows of other labels whose
score lies between LOW and HIGH per cent of the positive's.

Codes. A row is a centre c plus a rest d, and all rests are turned by one random rotation. A row keeps the
number of its centre, the signs of the turned components as bits, the length of d, and its alignment a:
the inner product of d with its unit code vector s. An anchor's components are rounded to BITS bits, so
that its inner product with a code is a few popcounts, off by no more than a known error. With d = a s + e
the score is <c, q> + a <s, q> + <e, q>, and by Cauchy-Schwarz the last term is at most |e| times the part
of q that is orthogonal to s. So every score has an interval that certainly holds it: no neighbour is
lost, recall is 1. Rows whose interval cannot reach what is asked (the best so far, the band of a
positive) are dropped; the others are scored on their integers. Centres are fitted on SAMPLE rows; they
only make intervals narrow where vectors lie in clusters, and every row is indexed.

Work is dealt in blocks: every block of anchors meets every block of rows, a group of row blocks to a
task, which keeps only the best of each anchor. No pair of rows is ever shuffled, only these.

Rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part. Shorter vectors
count as padded with zeros. Repeated rows are rows of their own: a copy of an anchor is another row, and
is an anchor itself. Rows without id are no anchors but can be positives and negatives. Components and
scores beyond a long are the nearest long; the largest long is no id but stands for NULL. Columns other
than the three named are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from assayer.llm.text import kept

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
#: Bits of a component of an anchor; rows have one.
BITS = 6
SEED = 11
#: Centres, the rows they are fitted on (those with the smallest hashes), and rounds of fitting.
CENTRES, SAMPLE, ROUNDS = 64, 4096, 8
#: Rows and anchors of one block, row blocks of one task, and anchors of one step within it.
ROWS_PER_BLOCK, ANCHORS_PER_BLOCK, BLOCKS_PER_GROUP, STEP = 8192, 16_384, 8, 256
#: Up to this share of a step's pairs survivors are scored one by one; beyond it the whole step is one product.
SPARSE = 0.05
#: Floating-point error of an interval, as a share of the lengths.
EPSILON = 1e-9
MOST = np.iinfo(np.int64).max

_PACKED = "block bigint, rids binary, ids binary, labels binary, vectors binary, homes binary, codes binary, lengths binary, aligned binary"
_BINARY = ("rids", "ids", "labels", "vectors", "homes", "codes", "lengths", "aligned")
_PACKED_SCHEMA = pa.schema([("block", pa.int64()), *[(name, pa.binary()) for name in _BINARY]])
_LONG = pa.int64()
_POSITIVE = pa.schema([("anchor", _LONG), ("block", _LONG), ("place", pa.int32()), ("anchor_id", _LONG), ("other", _LONG), ("other_id", _LONG), ("score", _LONG)])
_NEGATIVE = pa.schema([("anchor", _LONG), ("positive_rank", pa.int32()), ("other", _LONG), ("other_id", _LONG), ("score", _LONG)])


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix. It is made once and sent along, as its last bits depend on the machine."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]


def fitted(sample: np.ndarray, dims: int, count: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a sample, as integer vectors, so that what is left of a row is exact."""
    if not len(sample):
        return np.zeros((1, dims), dtype=np.int64)
    centres = sample[:count].astype(np.float64)
    for _ in range(rounds):
        home = nearest(sample, centres)
        size = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return np.clip(np.rint(centres), -(2.0**62), 2.0**62).astype(np.int64)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    doubles = centres.astype(np.float64)
    return np.argmin((doubles**2).sum(axis=1)[None, :] - 2 * rows.astype(np.float64) @ doubles.T, axis=1)


def encoded(vectors: np.ndarray, turn: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the centres, codes (n, words) as uint64, lengths and alignments of integer vectors (n, dims)."""
    homes = nearest(vectors, centres)
    turned = (vectors.astype(np.float64) - centres[homes].astype(np.float64)) @ turn
    bits = np.zeros((len(vectors), -(-turn.shape[0] // 64) * 64), dtype=np.uint8)
    bits[:, : turn.shape[0]] = turned >= 0
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    lengths = np.sqrt((turned**2).sum(axis=1))
    return homes, codes, lengths, np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[0])


def rounded(anchors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors as bit planes: planes (n, BITS, words), steps and offsets of the rounding, errors, lengths."""
    turned = anchors.astype(np.float64) @ turn
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum(high - low, 1e-300) / ((1 << BITS) - 1)
    units = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, (1 << BITS) - 1).astype(np.uint64)
    off = np.abs(turned - (low[:, None] + step[:, None] * units)).sum(axis=1) / math.sqrt(turn.shape[0])
    planes = np.zeros((len(anchors), BITS, -(-turn.shape[0] // 64) * 64), dtype=np.uint8)
    for bit in range(BITS):
        planes[:, bit, : turn.shape[0]] = (units >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(planes, axis=2, bitorder="little").view(np.uint64), step, low, off, np.sqrt((turned**2).sum(axis=1))


def intervals(homes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, aligned: np.ndarray, anchors: tuple, at_centres: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (anchors, rows) of the inner products, given those with the centres."""
    planes, step, low, off, anchor_lengths = anchors
    units = np.zeros((len(planes), len(codes)), dtype=np.float64)
    for bit in range(BITS):
        for word in range(codes.shape[1]):
            units += float(1 << bit) * np.bitwise_count(planes[:, bit, word][:, None] & codes[:, word][None, :])
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
    total = np.bitwise_count(planes).sum(axis=2).astype(np.float64) @ (1 << np.arange(BITS))
    # <s, q> with s = (2 bit - 1) / sqrt(dims) and q = low + step * units.
    along = (step[:, None] * (2 * units - total[:, None]) + low[:, None] * (2 * ones[None, :] - dims)) / math.sqrt(dims)
    rest = np.sqrt(np.maximum(0.0, lengths**2 - aligned**2))
    least = np.maximum(0.0, np.abs(along) - off[:, None])
    across = np.sqrt(np.maximum(0.0, anchor_lengths[:, None] ** 2 - least**2))
    base = at_centres[:, homes]
    half = aligned[None, :] * off[:, None] + rest[None, :] * across + EPSILON * (1 + np.abs(base) + lengths[None, :] * anchor_lengths[:, None])
    middle = base + aligned[None, :] * along
    return middle - half, middle + half


def _exact(anchors: np.ndarray, rows: np.ndarray) -> bool:
    """Whether sums of products are exact as doubles."""
    most = [max(float(x.max(initial=0)), -float(x.min(initial=0))) for x in (anchors, rows)]
    return most[0] * most[1] * rows.shape[1] < 2**53


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, rows) as int64; those beyond it are the nearest long."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    if _exact(anchors, rows):
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.array([[max(-MOST - 1, min(MOST, int(x))) for x in line] for line in exact], dtype=np.int64)


def _scored(anchors: np.ndarray, rows: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (anchor, row) where ``open_`` holds, with their scores."""
    at, of = np.nonzero(open_)
    if len(at) <= SPARSE * open_.size and _exact(anchors, rows):
        products = np.empty(len(at), dtype=np.int64)
        for begin in range(0, len(at), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            products[part] = np.einsum("ij,ij->i", anchors[at[part]].astype(np.int64), rows[of[part]].astype(np.int64))
        return at, of, products
    return at, of, scores(anchors, rows)[at, of]


class Block:
    """A packed block, with its rows ordered by id."""

    def __init__(self, row: dict, dims: int):
        unpack = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.rids, self.ids, self.labels = unpack("rids", np.int64), unpack("ids", np.int64), unpack("labels", np.int64)
        kind = np.dtype(f"i{len(row['vectors']) // max(1, len(self.rids) * dims)}") if len(self.rids) and dims else np.dtype("i8")
        self.vectors = unpack("vectors", kind).reshape(len(self.rids), dims)
        self.homes = unpack("homes", np.int64)
        self.codes = unpack("codes", np.uint64).reshape(len(self.rids), -1)
        self.lengths, self.aligned = unpack("lengths", np.float64), unpack("aligned", np.float64)


def _packer(size: int, dims: int, turn: np.ndarray, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(rids: list, ids: list, labels: list, vectors: list, number: int) -> pa.RecordBatch:
        table = np.zeros((len(vectors), dims), dtype=np.int64)
        for i, vector in enumerate(vectors):
            table[i, : len(vector)] = vector
        known = np.array([MOST if i is None else i for i in ids], dtype=np.int64)
        order = np.argsort(known, kind="stable")
        table, most = table[order], int(max(table.max(initial=0), -(table.min(initial=0) + 1)))
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        columns = [np.array(rids, dtype=np.int64)[order], known[order], np.array(labels, dtype=np.int64)[order], table.astype(kind), *encoded(table, turn, centres)]
        arrays = [pa.array([number], pa.int64()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, schema=_PACKED_SCHEMA)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, ([], [], [], [])
        for batch in batches:
            for part in range(0, batch.num_rows, size):
                for column, values in zip(held, batch.slice(part, size).columns, strict=True):
                    column.extend(values.to_pylist())
                while len(held[0]) >= size:
                    yield packed(*[c[:size] for c in held], number)
                    number, held = number + 1, tuple(c[size:] for c in held)
        if held[0]:
            yield packed(*held, number)

    return pack


def _best(keep: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> np.ndarray:
    """Places of the best ``keep`` of every group: highest score, then smallest id, then row."""
    order = np.lexsort((rids, ids, ~score, group))
    ordered = group[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.empty(0, np.int64)
    rank = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return order[rank < keep]


class _Tops:
    """The best rows of each group so far."""

    def __init__(self, groups: int, keep: int):
        self.keep, self.least = keep, np.full(groups, -np.inf)
        self.columns = [np.empty(0, np.int64) for _ in range(4)]  # group, score, ids, rids

    def add(self, *columns: np.ndarray) -> None:
        if not len(columns[0]):
            return
        merged = [np.concatenate(pair) for pair in zip(self.columns, columns, strict=True)]
        best = _best(self.keep, *merged)
        self.columns = [c[best] for c in merged]
        groups, counts = np.unique(self.columns[0], return_counts=True)
        full = groups[counts == self.keep]
        last = np.cumsum(counts)[counts == self.keep] - 1
        self.least[full] = self.columns[1][last]


def _floor_of(lower: np.ndarray, keep: int) -> np.ndarray:
    """Per anchor a bound that its best ``keep`` rows certainly reach: the keep-th largest lower bound."""
    if lower.shape[1] < keep:
        return np.full(len(lower), -np.inf)
    return np.partition(lower, lower.shape[1] - keep, axis=1)[:, lower.shape[1] - keep]


def _steps(own: Block, blocks: list[Block], turn: np.ndarray, centres: np.ndarray, groups: int, keep: int) -> Iterator[tuple]:
    """The anchors step by step, each with its best so far and every row block: (step, tops, block, lower, upper)."""
    for begin in range(0, len(own.rids), STEP):
        here = slice(begin, min(begin + STEP, len(own.rids)))
        tops = _Tops((here.stop - begin) * groups, keep)
        asked, at_centres = rounded(own.vectors[here], turn), own.vectors[here].astype(np.float64) @ centres.astype(np.float64).T
        for block in blocks:
            yield here, tops, block, *intervals(block.homes, block.codes, block.lengths, block.aligned, asked, at_centres, len(turn))


def _gathered(found: dict[int, _Tops]) -> list[np.ndarray]:
    """Group (over all steps), score, id and row of the best of every step."""
    return [np.concatenate([tops.columns[c] + (begin if c == 0 else 0) for begin, tops in found.items()]) for c in range(4)]


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, _LONG, mask=values == MOST)


def _positives(rows: pa.Table, anchors: pa.Table, turn: np.ndarray, centres: np.ndarray, keep: int) -> pa.Table:
    """The best rows of the same label for a block of anchors in a group of row blocks."""
    own, blocks, found = Block(anchors.to_pylist()[0], len(turn)), [Block(r, len(turn)) for r in rows.to_pylist()], {}
    for here, tops, block, lower, upper in _steps(own, blocks, turn, centres, 1, keep):
        found[here.start] = tops
        allowed = (own.labels[here][:, None] == block.labels[None, :]) & (own.rids[here][:, None] != block.rids[None, :])
        reach = np.maximum(_floor_of(np.where(allowed, lower, -np.inf), keep), tops.least)
        at, of, score = _scored(own.vectors[here], block.vectors, allowed & (upper >= reach[:, None]))
        inside = score >= tops.least[at]
        tops.add(at[inside], score[inside], block.ids[of[inside]], block.rids[of[inside]])
    at, score, ids, rids = _gathered(found)
    block = np.full(len(at), anchors.column("block")[0].as_py())
    return pa.Table.from_arrays([own.rids[at], block, pa.array(at, pa.int32()), own.ids[at], rids, _ids(ids), score], schema=_POSITIVE)


def _in_band(score: np.ndarray, positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, without overflow."""
    if not len(score):
        return np.zeros(0, dtype=bool)
    most = max(int(np.abs(score).max()), int(np.abs(positive).max())) * max(100, abs(low), abs(high))
    if most > MOST or score.min() == -MOST - 1 or positive.min() == -MOST - 1:
        score, positive = score.astype(object), positive.astype(object)
    return ((low * positive <= 100 * score) & (100 * score <= high * positive)).astype(bool)


def _negatives(rows: pa.Table, anchors: pa.Table, turn: np.ndarray, centres: np.ndarray, keep: int, low: int, high: int, most: int) -> pa.Table:
    """The best rows of other labels within the band of each positive, of which an anchor has up to ``most``."""
    asked = anchors.to_pylist()[0]
    own, blocks, found = Block(asked, len(turn)), [Block(r, len(turn)) for r in rows.to_pylist()], {}
    positive = np.zeros((len(own.rids), most), dtype=np.int64)
    given = np.zeros((len(own.rids), most), dtype=bool)
    for p in asked["positives"]:
        positive[p["place"], p["rank"] - 1], given[p["place"], p["rank"] - 1] = p["score"], True
    slack = EPSILON * (1 + np.abs(positive.astype(np.float64)))
    bottom, top = np.where(given, positive * (low / 100) - slack, np.inf), np.where(given, positive * (high / 100) + slack, -np.inf)
    for here, tops, block, lower, upper in _steps(own, blocks, turn, centres, most, keep):
        found[here.start * most] = tops
        other = own.labels[here][:, None] != block.labels[None, :]
        open_, reach = np.zeros(other.shape, dtype=bool), np.maximum(bottom[here], tops.least.reshape(-1, most))
        for k in range(most):
            from_k, to_k = bottom[here][:, k][:, None], top[here][:, k][:, None]
            certain = np.where(other & (lower >= from_k) & (upper <= to_k), lower, -np.inf)
            reach[:, k] = np.maximum(reach[:, k], _floor_of(certain, keep))
            open_ |= other & (upper >= reach[:, k][:, None]) & (lower <= to_k)
        at, of, score = _scored(own.vectors[here], block.vectors, open_)
        for k in range(most):
            near = (score >= reach[at, k]) & (score <= top[here][at, k])
            a, o, s = at[near], of[near], score[near]
            inside = _in_band(s, positive[here][a, k], low, high)
            a, o, s = a[inside], o[inside], s[inside]
            tops.add(a * most + k, s, block.ids[o], block.rids[o])
    at, score, ids, rids = _gathered(found)
    return pa.Table.from_arrays([own.rids[at // most], pa.array(at % most + 1, pa.int32()), rids, _ids(ids), score], schema=_NEGATIVE)


def _packed(rows: DataFrame, size: int, dims: int, turn: np.ndarray, centres: np.ndarray, label: str) -> DataFrame:
    return kept(rows.select("rid", "id", "label", "vector").mapInArrow(_packer(size, dims, turn, centres), _PACKED), label)


def _sample(points: DataFrame, dims: int, rows: int = SAMPLE) -> np.ndarray:
    """The vectors of at most ``rows`` rows, those with the smallest hashes."""
    taken = points.select(F.xxhash64("rid").alias("h"), "vector").orderBy("h").limit(rows).collect()
    return np.array([[*r.vector, *[0] * (dims - len(r.vector))] for r in taken], dtype=np.int64).reshape(len(taken), dims)


def prepared(rows: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """Rows that take part (rid, id, label, vector of longs), written, with a number of their own."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    doubles = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    whole = doubles.where("label is not null and vector is not null").where(F.forall("vector", sound))
    integers = whole.select(F.monotonically_increasing_id().alias("rid"), "id", "label", F.transform("vector", lambda x: F.floor(x * SCALE).cast("bigint")).alias("vector"))
    return kept(integers, "hardneg-rows")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Hard negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), with ``positive_rank``.

    ``is_anchor`` is a condition on the column ``id``, the id of a row.
    """
    points = prepared(rows, vec_id, F.col(label) if isinstance(label, str) else label, vector)
    dims = max(1, points.agg(F.max(F.size("vector"))).first()[0] or 0)
    turn, centres = rotation(dims), fitted(_sample(points, dims), dims)
    blocks = _packed(points, ROWS_PER_BLOCK, dims, turn, centres, "hardneg-blocks")
    asked = points.where(is_anchor)
    anchors = _packed(asked.repartition(max(1, math.ceil(asked.count() / ANCHORS_PER_BLOCK))), ANCHORS_PER_BLOCK, dims, turn, centres, "hardneg-anchors")

    # One row of numbers per block of anchors: each meets every group of row blocks.
    asking = F.lit([r.block for r in anchors.select("block").collect()]).cast("array<bigint>")
    groups = max(1, math.ceil(blocks.count() / BLOCKS_PER_GROUP))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("asking", F.explode(asking))

    def met(questions: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            return run(left, right) if left.num_rows and right.num_rows else schema.empty_table()

        placed = questions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asking", F.col("block"))
        return dealt.groupBy("asking", "part").cogroup(placed.groupBy("asking", "part")).applyInArrow(both, from_arrow_schema(schema))

    order = [F.col("score").desc(), F.col("other_id").asc_nulls_last(), F.col("other")]

    def best(found: DataFrame, keep: int, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return found.withColumn("rank", place).where(F.col("rank") <= keep)

    near = met(anchors, lambda a, b: _positives(a, b, turn, centres, positives), _POSITIVE)
    chosen = kept(best(near, positives, "anchor"), "hardneg-positives")
    listed = chosen.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("positives"))
    banded = met(anchors.join(listed, "block"), lambda a, b: _negatives(a, b, turn, centres, negatives, low, high, positives), _NEGATIVE)
    found = best(banded, negatives, "anchor", "positive_rank").select("anchor", "positive_rank", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select("anchor", "anchor_id", F.col("rank").alias("positive_rank"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found, ["anchor", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
