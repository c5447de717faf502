"""MinHash near-duplicates on bags of word shingles: BagMinHash signatures, bands, exact verification.

A text's bag counts its shingles of five lower-cased (A-Z) words; shorter texts are one shingle of all
their words. Similarity is the weighted Jaccard of two bags: sum of minima over sum of maxima.

Signatures. For every shingle and every weight interval (0,1], (1,2], (2,4], (4,8], ... that its count
reaches, a Poisson process of points in time is drawn from the shingle's hash alone. Each point has a
uniform place in the interval, which stands for the finer intervals below it, and counts if the place is
within the shingle's weight; it hits one uniform component, and the earliest point of a component is its
value. Points are only drawn until every component has one, so a text costs about a point per shingle.
Two texts agree in a component with the probability of their weighted Jaccard.

Links. Equal bags are one node. Bands of a few components make buckets. In each bucket every node is
paired with the smallest node of the bucket, not with all others; pairs whose signatures agree are
verified on the bags themselves. Where a bucket of three or more had a pair that was refused, the refused
nodes may have links to its other nodes: their bags are compared with all bags of the bucket exactly, by
products of incidence matrices, in blocks of bounded size, and every block returns no more than the
links that connect it. So no link between different texts is lost to the choice of the pivot, and no
pairs are emitted beyond a forest. Connected nodes are classes.

NULL texts, and texts without words, are each a class of their own. The class id is the smallest doc_id
of the class (NULL if all its ids are NULL). Repeated rows are in one class and keep their rows. Texts are
read whole; the work and memory of a text grow with its words. Columns other than id and text are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.text import fingerprint, free, kept, sieved

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
COMPONENTS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are not verified: over five standard errors below 0.8.
ESTIMATE = 0.55
#: Texts of one vectorised step.
STEP_CHARS = 2_000_000
#: Nodes and shingles of one block of a bucket; two blocks are compared in one task.
BLOCK_NODES, BLOCK_UNITS = 1000, 500_000
#: Shingles of one matrix product.
COLUMNS = 2048

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs give unrelated outputs."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


class _Ids(dict):
    """Words to consecutive numbers, as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every token; each distinct word is hashed once."""
    ids = _Ids()
    numbers = np.fromiter(map(ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    digests = np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids))
    return digests[numbers]


def bags(texts: list[str | None], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingle hashes, ascending, and their counts."""
    split = [(t or "").encode("utf-8").lower().split() for t in texts]
    hashes = word_hashes([w for tokens in split for w in tokens])
    out, start = [], 0
    for tokens in split:
        own = hashes[start : start + len(tokens)]
        start += len(tokens)
        if not tokens:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        n = max(1, len(own) - size + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(min(size, len(own))):
            rolled = mixed(rolled ^ own[j : j + n])
        out.append(np.unique(rolled, return_counts=True))
    return out


def bag(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return bags([text], size)[0]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][ia], b[1][ib]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0


def signatures(counted: list[tuple[np.ndarray, np.ndarray]], size: int = COMPONENTS) -> np.ndarray:
    """One row of ``size`` uint32 per bag; all zeros for empty bags."""
    lengths = np.array([len(h) for h, _ in counted], dtype=np.int64)
    hashes = np.concatenate([h for h, _ in counted]) if counted else np.empty(0, np.uint64)
    weights = np.concatenate([c for _, c in counted]) if counted else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(counted)), lengths)
    total = np.bincount(owner, weights=weights, minlength=len(counted))
    best = np.full((len(counted), size), np.inf)
    value = np.zeros((len(counted), size), dtype=np.uint32)

    # One stream per shingle and weight interval (low, low + width] that its weight reaches.
    streams = []
    low, width, level = 0, 1, 0
    some = np.flatnonzero(weights > 0)
    while len(some):
        seed = mixed(hashes[some] ^ mixed(np.full(1, level + 1, dtype=np.uint64)))
        streams.append((owner[some], seed, (weights[some] - low).astype(np.float64), np.full(len(some), float(width))))
        low, width, level = low + width, max(1, low + width), level + 1
        some = some[weights[some] > low]
    if not streams:
        return value
    own, seed, reach, wide = (np.concatenate(x) for x in zip(*streams, strict=True))
    time, draw = np.zeros(len(own)), np.zeros(1, dtype=np.uint64)
    horizon = (np.log(size) + 4.0) / np.maximum(total, 1.0) / size
    pending = np.flatnonzero(total > 0)
    state = seed.copy()
    time = -np.log(unit(mixed(state))) / (wide * size)
    while True:
        active = np.flatnonzero(time <= horizon[own])
        while len(active):
            r = mixed(state[active] ^ _U(0xA5A5A5A5A5A5A5A5))
            component = ((r & _U(0xFFFFFFFF)) % _U(size)).astype(np.int64)
            inside = unit(mixed(r)) * wide[active] <= reach[active]
            at, comp, when, mark = own[active][inside], component[inside], time[active][inside], (r[inside] >> _U(32)).astype(np.uint32)
            # Earliest point per component: written latest first, so that the earliest stays.
            order = np.argsort(-when, kind="stable")
            at, comp, when, mark = at[order], comp[order], when[order], mark[order]
            first = np.full(best.shape, np.inf) if len(at) > best.size else None
            if first is None:
                flat = at * size + comp
                earliest, index = np.unique(flat[::-1], return_index=True)
                index = len(flat) - 1 - index
                better = when[index] < best.reshape(-1)[earliest]
                best.reshape(-1)[earliest[better]] = when[index][better]
                value.reshape(-1)[earliest[better]] = mark[index][better]
            else:
                first[at, comp] = when
                marks = np.zeros(best.shape, dtype=np.uint32)
                marks[at, comp] = mark
                better = first < best
                best[better], value[better] = first[better], marks[better]
            state[active] = mixed(state[active] ^ _GOLD)
            time[active] += -np.log(unit(mixed(state[active]))) / (wide[active] * size)
            active = active[time[active] <= horizon[own[active]]]
        pending = pending[np.isinf(best[pending]).any(axis=1)]
        if not len(pending):
            return value
        horizon[pending] *= 2.0


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in text.split(", "))])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema("row long, doc_id long, print long, node binary, units long, sig binary, bands array<long>, body binary")
    row = TaskContext.get().partitionId() << 40
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < STEP_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            counted = bags(texts[start:stop])
            signed = signatures(counted)
            banded = np.zeros((len(counted), BANDS), dtype=np.uint64)
            for k in range(BANDS):
                for j in range(ROWS):
                    banded[:, k] = mixed(banded[:, k] ^ signed[:, k * ROWS + j].astype(np.uint64) ^ _U(k + 1 << 40))
            nodes = [xxhash.xxh128_digest(h.tobytes() + c.astype(np.int64).tobytes()) if len(h) else None for h, c in counted]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + stop - start), pa.int64()),
                    ids.slice(start, stop - start).cast(pa.int64()),
                    batch.column(2).slice(start, stop - start),
                    pa.array(nodes, pa.binary()),
                    pa.array([int(c.sum()) for _, c in counted], pa.int64()),
                    pa.array([s.tobytes() for s in signed], pa.binary()),
                    pa.array(list(banded.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([squeeze.compress((t or "").encode("utf-8")) for t in texts[start:stop]], pa.binary()),
                ],
                schema=schema,
            )
            row += stop - start
            start = stop


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    schema = _schema("a binary, b binary")
    expand = zstandard.ZstdDecompressor()
    last, left = None, None
    for batch in batches:
        a, b, body_a, body_b = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i in range(len(a)):
            if a[i] != last:
                last, left = a[i], bag(expand.decompress(body_a[i]).decode("utf-8"))
            right = bag(expand.decompress(body_b[i]).decode("utf-8"))
            keep.append(weighted_jaccard(left, right) >= least)
        mask = np.array(keep, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, mask, strict=True) if k], pa.binary()), pa.array([x for x, k in zip(b, mask, strict=True) if k], pa.binary())], schema=schema)


def similar(counted: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, columns: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of different bags at least ``least`` similar, from exact counts of common shingles.

    A shingle that occurs c times is c entries (shingle, 1) ... (shingle, c), so that common entries are
    the sum of minima. Entries that only one bag has are left out of the products. A bag that is row and
    column is not paired with itself.
    """
    totals = np.array([c.sum() for _, c in counted], dtype=np.float64)
    owner = np.repeat(np.arange(len(counted)), [int(c.sum()) for _, c in counted])
    keys = [np.repeat(h, c) for h, c in counted]
    level = [np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) for _, c in counted]
    entries = mixed(np.concatenate(keys) ^ mixed(np.concatenate(level).astype(np.uint64)))
    _, number, times = np.unique(entries, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    place = np.full((2, len(counted)), -1)
    place[0, rows], place[1, columns] = np.arange(len(rows)), np.arange(len(columns))
    common = np.zeros((len(rows), len(columns)), dtype=np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    for begin in range(0, width, COLUMNS):
        low, high = np.searchsorted(number, [begin, begin + COLUMNS])
        part = []
        for side, size in ((0, len(rows)), (1, len(columns))):
            matrix, at = np.zeros((size, COLUMNS), dtype=np.float32), place[side, owner[low:high]]
            matrix[at[at >= 0], number[low:high][at >= 0] - begin] = 1
            part.append(matrix)
        common += part[0] @ part[1].T
    union = totals[rows][:, None] + totals[columns][None, :] - common
    found = np.nonzero((common >= least * union - 1e-9) & (union > 0) & (rows[:, None] != columns[None, :]))
    return [(int(rows[i]), int(columns[j])) for i, j in zip(*found, strict=True)]


def _forest(table: pa.Table, least: float) -> pa.Table:
    """Links that connect the similar nodes of a block of refused nodes (side 0) and a block of all nodes (side 1) of a bucket."""
    expand = zstandard.ZstdDecompressor()
    nodes, side = table.column("node").to_pylist(), np.array(table.column("side").to_pylist())
    numbers = {n: i for i, n in enumerate(dict.fromkeys(nodes))}
    bodies = dict(zip(nodes, table.column("body").to_pylist(), strict=True))
    counted = bags([expand.decompress(bodies[n]).decode("utf-8") for n in numbers])
    of_side = [np.array([numbers[n] for n, s in zip(nodes, side, strict=True) if s == k], dtype=np.int64) for k in (0, 1)]
    names, parent = list(numbers), list(range(len(numbers)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in similar(counted, *of_side, least) if len(of_side[0]) and len(of_side[1]) else []:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((min(names[i], names[j]), max(names[i], names[j])))
    return pa.table({"a": pa.array([p[0] for p in links], pa.binary()), "b": pa.array([p[1] for p in links], pa.binary())})


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least the share ESTIMATE."""
    sig = lambda n: nodes.select(F.col("node").alias(n), F.col("sig").alias(f"sig_{n}"))
    both = pairs.join(sig("a"), "a").join(sig("b"), "b")
    at = F.sequence(F.lit(0), F.lit(COMPONENTS - 1))
    part = lambda c, i: F.substr(F.col(c), i * 4 + 1, F.lit(4))
    agree = F.size(F.filter(at, lambda i: part("sig_a", i) == part("sig_b", i)))
    return both.where(agree >= int(ESTIMATE * COMPONENTS)).select("a", "b")


def _links(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose bags are at least ``least`` similar."""
    body = lambda n: nodes.select(F.col("node").alias(n), F.col("body").alias(f"body_{n}"))
    both = pairs.join(body("b"), "b").join(body("a"), "a").select("a", "b", "body_a", "body_b")
    return kept(both.mapInArrow(lambda batches: _verified(batches, least), "a binary, b binary"), "near-links")


def _crowded(buckets: DataFrame, links: DataFrame, bodies: DataFrame) -> DataFrame:
    """Blocks of buckets in which the pivot refused a node: rows (bucket, i, j, side, node, body).

    Only refused nodes can have links that are not found yet; those the pivot accepted are connected
    through it. So blocks i of refused nodes (side 0) meet blocks j of all nodes (side 1).
    """
    blocks = lambda n, total: F.greatest(F.ceil(F.col(n) / BLOCK_NODES), F.ceil(F.col(total) / BLOCK_UNITS))
    refused = buckets.where("n > 2 and node <> pivot").join(links, (F.col("pivot") == F.col("a")) & (F.col("node") == F.col("b")), "left_anti")
    refused = kept(refused.select("bucket", "node", "units"), "near-refused")
    sizes = refused.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_refused"), F.sum("units").alias("refused_total"))
    marked = buckets.join(sizes, "bucket").join(refused.select("bucket", "node", F.lit(True).alias("refused")), ["bucket", "node"], "left").join(bodies, "node")
    placed = marked.withColumn("rows", blocks("n_refused", "refused_total")).withColumn("columns", blocks("n", "total"))
    at = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    upto = lambda count: F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)
    as_column = F.transform(upto("rows"), lambda i: F.struct(i.alias("i"), at("columns").alias("j"), F.lit(1).alias("side")))
    as_row = F.transform(upto("columns"), lambda j: F.struct(at("rows").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    meets = F.when(F.col("refused"), F.concat(as_column, as_row)).otherwise(as_column)
    return placed.select("bucket", "node", "body", F.explode(meets).alias("m")).select("bucket", "m.i", "m.j", "m.side", "node", "body")


def _labelled(docs: DataFrame, least: float) -> DataFrame:
    """Rows (doc_id, print, label, link_count), a row per document; no label where a text has no words."""
    fields = "row long, doc_id long, print long, node binary, units long, sig binary, bands array<long>, body binary"
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", fingerprint(F.col("text")).alias("print"))
    signed = kept(rows.mapInArrow(_signed, fields), "near-signatures")
    once = F.struct("row", "units", "sig", "bands")
    nodes = kept(signed.where("node is not null").groupBy("node").agg(F.min(once).alias("n")).select("node", "n.*"), "near-nodes")
    banded = nodes.select("node", "units", F.explode("bands").alias("bucket"))
    counted = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"), F.sum("units").alias("total"))
    buckets = kept(banded.join(counted.where("n > 1"), "bucket"), "near-buckets")
    pairs = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = kept(_estimated(pairs, nodes), "near-stars")
    # A node's body is that of one of its rows: rows are found by their own number, so copies do not meet.
    members = nodes.select("row", "node").join(buckets.select("node").distinct(), "node", "left_semi")
    bodies = kept(signed.select("row", "body").join(members, "row").select("node", "body"), "near-bodies")
    links = _links(stars, bodies, least)
    more = _crowded(buckets, links, bodies).groupBy("bucket", "i", "j").applyInArrow(lambda t: _forest(t, least), "a binary, b binary")
    links = links.unionByName(kept(more, "near-links")).distinct()
    labels = kept(components(links), "near-classes")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("link_count"))
    named = signed.select("doc_id", "print", "node").join(labels, "node", "left").join(degree, "node", "left")
    links_of = F.coalesce("link_count", F.lit(0)).cast("bigint")
    return kept(named.select("doc_id", "print", F.coalesce("label", "node").alias("label"), links_of.alias("link_count")), "near-labels")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, class_id, class_size (document rows) and link_count of its text.

    ``link_count`` counts the verified links of the text to different texts, which are those that were
    needed to connect the class; texts of a class are not compared all with all.
    """
    named = _labelled(docs, least)
    sized = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    own = named.join(kept(sized, "near-sizes"), "label", "left")
    alone = F.col("label").isNull()
    return own.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("class_size")).alias("class_size"), "link_count")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document row of each class, that with the smallest id (NULL last; among its texts the smallest fingerprint).

    Rows are told apart by id and text, so an id on two texts loses only the text that is a copy. Of rows
    equal in id and text one stays, the smallest by a hash of its columns. All columns stay, whatever their
    names. Texts without words are classes of their own and all stay. Only rows that may have to go are moved
    to be looked up, the others stay where they are.
    """
    its_id, its_print, its_row, maybe = (free(docs, name) for name in ("near_id", "near_print", "near_row", "near_maybe"))
    named = _labelled(docs, least).where("label is not null").groupBy("label", "doc_id", "print").agg(F.count(F.lit(1)).alias("n"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print")).alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print"))
    judged = kept(named.join(first, "label").select(F.col("doc_id").alias(its_id), F.col("print").alias(its_print), "n", is_first.alias("stays")), "near-judged")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(its_id)) & (fingerprint(F.col("text")) == F.col(its_print))
    ties = judged.where("stays and n > 1").select(its_id, its_print)
    gone = judged.where("not stays or n > 1").select(its_id, its_print)
    marked = sieved(docs, F.xxhash64(F.col("doc_id").cast("bigint"), fingerprint(F.col("text"))), gone.select(F.xxhash64(its_id, its_print)), maybe)
    asked = marked.where(maybe).select(*docs.columns)
    single = marked.where(~F.col(maybe)).select(*docs.columns).unionByName(asked.join(gone, same, "left_anti"))
    if ties.isEmpty():
        return single
    row = F.struct(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]).alias("hash"), F.struct(*docs.columns).alias("row"))
    one = asked.join(ties, same).groupBy(its_id, its_print).agg(F.min(row).alias(its_row))
    return single.unionByName(one.select(f"{its_row}.row.*"))
