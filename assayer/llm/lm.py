"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of a text with A-Z in lower case, and one end per text. Exact counts of all training
tokens come from all documents by way of shards (see ``blocks``). The most frequent tokens are heads, dealt
into head classes by frequency; all others go into tail classes by their ending. Below a class stands a tree
of nodes with WIDTH branches: a head is a leaf of its own, a tail token goes by its hash to a bucket. The model is

    P(token | before) = P(class | before) * P(branch | node, before) * ... * P(token | bucket)

All factors but the last are softmaxes with weights for hashed features of what stands before: the last token
(a bigram), the one before it, whatever stands between (a skip), and both (a trigram). Within its bucket a tail
token has its smoothed share of the bucket's count, so that unseen tokens have a probability too. Heads, depth of
the trees and rows of weights grow with the counted vocabulary (see ``Shape``). Weights start at the counts and
are trained by gradient steps: in each round every task starts from the same weights, goes through its blocks
once in mini-batches, and sends how far it moved each row of weights; rows are averaged by how often they were
used, chunk by chunk. The rounds part the training documents between them, so each is learned from once.

NULL and empty texts are one end token. A NULL id counts as the empty text, whose remainder is 0: held
out. Repeated rows are learned from and scored one by one. An empty table gives no rows. Scores depend
on how the rows are dealt over files, for gradient steps have an order; the counts do not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.blocks import answered, blocks_of, pack, shard_count
from assayer.llm.text import kept

END = b""
HELD_OUT_OF = 10
SMOOTH = 0.1
HEAD_CLASSES, TAIL_CLASSES, WIDTH = 16, 16, 32
#: Heads and rows of weights there are at least.
HEADS, CLASSES = HEAD_CLASSES * WIDTH, HEAD_CLASSES + TAIL_CLASSES
TABLE = 1 << 14
#: Buckets are counted at this depth and summed to the depth of the model. Heads one shard names at most.
DEEPEST, NAMED = 4, HEAD_CLASSES * WIDTH**2
#: Tail words a bucket has on average at most.
BUCKET = 256
ROUNDS, BATCH, RATE = 2, 16384, 0.5
#: Tokens whose logits are added at a time, and the size up to which exp is taken of them as they are.
STEP, SAFE = 2048, 80.0
#: Uses from which on a row's slopes are summed on their own.
OFTEN = 64
#: Blocks learned from by one task of a round at least, for tables of up to TASK_TABLE rows; its weights are sent once.
BLOCKS_PER_TASK, TASK_TABLE = 16, 1 << 16
#: Rows of weights sent together.
CHUNK = 256

_U = np.uint64
MESSAGE = "shard int, block bigint, words binary, counts binary"
_MESSAGE = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
ANSWER = "block bigint, shard int, counts binary, heads array<struct<word:binary,n:bigint>>, totals binary"
_HEADS = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("counts", pa.binary()), ("heads", _HEADS), ("totals", pa.binary())])
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


@dataclass
class Tokens:
    numbers: np.ndarray  # of every token, documents one after the other
    vocabulary: list[bytes]
    digests: np.ndarray  # hash of every word of the vocabulary
    lengths: np.ndarray  # tokens of every document
    training: np.ndarray  # for every document


def _words(data: np.ndarray, sizes: np.ndarray) -> pa.DictionaryArray:
    """Words that stand one after the other, numbered."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def _listed(words: pa.LargeBinaryArray) -> list[bytes]:
    _, at, data = words.buffers()
    ends, whole = np.frombuffer(at, np.int64, len(words) + 1).tolist(), b"" if data is None else data.to_pybytes()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of every text, the number of every token, the vocabulary by number."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    inside = (data - np.uint8(9) > 4) & (data != 32)  # as every text stands between line ends, words begin and end in pairs
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # up to the end of every text
    coded = _words(data[inside], np.insert(ends - starts, words, len(END)))
    return np.diff(words, prepend=0) + 1, coded.indices.to_numpy(), _listed(coded.dictionary)


def _tokens(doc_ids: list[int | None], lengths: np.ndarray, numbers: np.ndarray, vocabulary: list[bytes]) -> Tokens:
    digests = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
    return Tokens(numbers.astype(np.int64), vocabulary, digests, lengths, np.array([not held_out(d) for d in doc_ids], dtype=bool))


def tokens_of(doc_ids: list[int | None], texts: list[bytes]) -> Tokens:
    return _tokens(doc_ids, *_split(texts))


def _write(texts: list[bytes]) -> tuple[list[int], bytes]:
    """A block's tokens, so that its texts are split once: the numbers byte by byte, which packs well, then the vocabulary."""
    lengths, numbers, vocabulary = _split(texts)
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return lengths.tolist(), zstandard.ZstdCompressor(level=3).compress(planes.tobytes() + b"\n".join(vocabulary))


def _read(sizes: list[int], body: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    whole, lengths = zstandard.ZstdDecompressor().decompress(body), np.array(sizes, dtype=np.int64)
    planes = np.frombuffer(whole, np.uint8, 4 * int(lengths.sum())).reshape(4, -1)
    return lengths, np.ascontiguousarray(planes.T).view("<u4").reshape(-1), whole[planes.size :].split(b"\n")


def _by_shard(t: Tokens, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vocabulary by shard, in the order it is sent and answered."""
    shard = (t.digests % _U(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)  # short ones sort faster
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def _sent(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for block, doc_ids, split in blocks_of(batches, _read):
        t = _tokens(doc_ids, *split)
        counts = np.bincount(t.numbers[np.repeat(t.training, t.lengths)], minlength=len(t.vocabulary))
        rows: list[list] = [[] for _ in _MESSAGE]
        for shard, words in _by_shard(t, shards):
            text = squeeze.compress(b"\n".join([t.vocabulary[i] for i in words.tolist()]))
            for column, value in zip(rows, (shard, block, text, counts[words].astype(np.int32).tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _MESSAGE, strict=True)], schema=_MESSAGE)


class _Tails(dict):
    """Endings to tail classes."""

    def __missing__(self, ending: bytes) -> int:
        found = self[ending] = xxhash.xxh32_intdigest(ending) % TAIL_CLASSES
        return found


_tails = _Tails()


def tail_class(word: bytes) -> int:
    return _tails[word[-2:]]


@dataclass(frozen=True)
class Shape:
    """Sizes of a model: at least sqrt(vocabulary) heads and 32 times as many rows, BUCKET tail words a bucket."""

    head_depth: int = 1
    tail_depth: int = 0
    table: int = TABLE

    @classmethod
    def of(cls, types: int) -> Shape:
        head_depth, tail_depth, table = 1, 0, TABLE
        while (HEAD_CLASSES * WIDTH**head_depth) ** 2 < types and head_depth < 2:  # 2 reaches 2 ** 28 types, see NAMED
            head_depth += 1
        while TAIL_CLASSES * WIDTH**tail_depth * BUCKET < types and tail_depth < DEEPEST:
            tail_depth += 1
        while table * table < 1024 * types:
            table *= 2
        return cls(head_depth, tail_depth, table)

    @property
    def heads(self) -> int:
        return HEAD_CLASSES * WIDTH**self.head_depth


_BITS = WIDTH.bit_length() - 1


def _buckets(tails: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Buckets at the greatest depth; the upper bits of the hash, as the lower ones choose the shard."""
    return (tails << (_BITS * DEEPEST)) | (digests >> _U(64 - _BITS * DEEPEST)).astype(np.int64)


def _summed(table: pa.Table) -> pa.Table:
    """Training counts of a shard's words for every block that sent them; the first answer also has what the model needs."""
    expand = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"\n".join([*map(expand.decompress, table.column("words").to_pylist()), b""]), np.uint8)
    ends = np.flatnonzero(data == 10)
    coded = _words(data[data != 10], np.diff(ends, prepend=-1) - 1)
    counts = [np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()]
    numbers, words = coded.indices.to_numpy(), coded.dictionary
    total = np.bincount(numbers, np.concatenate(counts), len(words)).astype(np.int64)  # exact below 2 ** 53
    seen = np.flatnonzero(total)
    known, tokens = words.take(pa.array(seen)), total[seen]
    # tokens and types of every bucket, as if no word were a head
    totals = np.stack([buckets_of(_listed(known), Shape(tail_depth=DEEPEST)), tokens], axis=1).tobytes()
    first = pc.sort_indices(pa.table({"word": known, "n": tokens}), [("n", "descending"), ("word", "ascending")])[:NAMED]
    named = pa.StructArray.from_arrays([known.take(first).cast(pa.binary()), pa.array(tokens).take(first)], fields=list(_HEADS.value_type))
    n = table.num_rows
    heads = pa.ListArray.from_arrays(pa.array([0, *[None] * (n - 1), len(named)], pa.int32()), named).cast(_HEADS)
    answers = [total[x].tobytes() for x in np.split(numbers, np.cumsum([len(c) for c in counts])[:-1])]
    return pa.table([table.column("block"), table.column("shard"), pa.array(answers, pa.binary()), heads, pa.array([totals, *[None] * (n - 1)], pa.binary())], schema=_ANSWER)


TOTALS = "bucket bigint, tokens bigint, types bigint"


def _at_depth(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """A shard's tokens and types of every bucket of this depth."""
    for batch in batches:
        for x in batch.column(0).to_pylist():
            words = np.frombuffer(x, np.int64).reshape(-1, 2)
            own, back = np.unique(words[:, 0] >> (_BITS * (DEEPEST - depth)), return_inverse=True)
            tokens = np.bincount(back, words[:, 1], len(own)).astype(np.int64)  # exact below 2 ** 53
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(tokens), pa.array(np.bincount(back, minlength=len(own)).astype(np.int64))], names=["bucket", "tokens", "types"])


def totals_of(answers: DataFrame, depth: int) -> np.ndarray:
    """Tokens, then types of every bucket of this depth."""
    some = answers.where("totals IS NOT NULL").select("totals").mapInArrow(lambda batches: _at_depth(batches, depth), TOTALS)
    table = some.groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toArrow()
    out = np.zeros((2, TAIL_CLASSES * WIDTH**depth), dtype=np.int64)
    out[:, table.column("bucket").to_numpy()] = table.column("tokens").to_numpy(), table.column("types").to_numpy()
    return out.reshape(-1)


@dataclass
class Model:
    heads: dict[bytes, int]
    shape: Shape
    tail_tokens: np.ndarray  # of every bucket
    tail_types: np.ndarray
    train_tokens: int
    train_types: int
    class_bias: np.ndarray
    inner_bias: np.ndarray  # of every node of the trees: those of the heads level by level, then those of the tails
    class_weights: np.ndarray
    head_weights: np.ndarray  # of all nodes of the trees

    @cached_property
    def head_digests(self) -> np.ndarray:
        return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, self.heads), dtype=np.uint64, count=len(self.heads)))

    @classmethod
    def of_counts(cls, heads: list[tuple[bytes, int]], sums: list[int], shape: Shape = Shape()) -> Model:  # noqa: B008
        tokens, types = (np.array(x, dtype=np.float64) for x in np.array(sums).reshape(2, -1))
        n, v = int(tokens.sum()), int(types.sum())
        buckets = buckets_of([w for w, _ in heads], shape)
        np.subtract.at(tokens, buckets, [c for _, c in heads])
        np.subtract.at(types, buckets, 1)
        own = np.zeros(shape.heads)
        own[: len(heads)] = [c for _, c in heads]
        class_counts = np.concatenate([own.reshape(HEAD_CLASSES, -1).sum(axis=1), tokens.reshape(TAIL_CLASSES, -1).sum(axis=1)])
        levels = [own.reshape(HEAD_CLASSES * WIDTH**j, WIDTH, -1).sum(axis=2) + SMOOTH for j in range(shape.head_depth)]
        levels += [(tokens + SMOOTH * (types + 1)).reshape(TAIL_CLASSES * WIDTH**j, WIDTH, -1).sum(axis=2) for j in range(shape.tail_depth)]
        zeros = lambda width: np.zeros((shape.table, width), dtype=np.float32)
        return cls({w: i for i, (w, _) in enumerate(heads)}, shape, tokens, types, n, v, np.log(class_counts + 1).astype(np.float32), np.log(np.concatenate(levels)).astype(np.float32), zeros(CLASSES), zeros(WIDTH))


def buckets_of(words: list[bytes], shape: Shape, digests: np.ndarray | None = None) -> np.ndarray:
    """The bucket of every word, were it no head."""
    if digests is None:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    endings = pc.binary_slice(pa.array(words, pa.large_binary()), -2).dictionary_encode()
    tails = np.array([_tails[e] for e in endings.dictionary.to_pylist()], dtype=np.int64)[endings.indices.to_numpy()]
    return _buckets(tails, digests) >> (_BITS * (DEEPEST - shape.tail_depth))


_MARKS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def features(t: Tokens) -> np.ndarray:
    """Hashes of the features of every token: the last token, the one before it, and both."""
    hashes = t.digests[t.numbers]
    starts = np.cumsum(t.lengths) - t.lengths
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    begin = _U(1)
    one[starts], two[starts] = begin, begin
    two[(starts + 1)[t.lengths > 1]] = begin
    return np.stack([_mixed(one ^ _MARKS[0]), _mixed(two ^ _MARKS[1]), _mixed(one * _MARKS[2] ^ _mixed(two))], axis=1)


def _places(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of the vocabulary: its class, the nodes below it and the branches taken there (-1 below its depth), its bucket (-1 for heads)."""
    shape = model.shape
    heads, known = np.full(len(t.vocabulary), -1, dtype=np.int64), model.head_digests
    may = np.flatnonzero(known.take(np.searchsorted(known, t.digests), mode="clip") == t.digests) if len(known) else []
    heads[may] = [model.heads.get(t.vocabulary[i], -1) for i in may]
    buckets, head = buckets_of(t.vocabulary, shape, t.digests), heads >= 0
    nodes = np.full((max(shape.head_depth, shape.tail_depth), len(heads)), -1, dtype=np.int64)
    branches, before = nodes.copy(), 0
    for which, numbers, depth, classes in ((head, heads, shape.head_depth, HEAD_CLASSES), (~head, buckets, shape.tail_depth, TAIL_CLASSES)):
        for j in range(depth):
            at = numbers[which] >> (_BITS * (depth - 1 - j))
            nodes[j, which], branches[j, which] = before + (at >> _BITS), at & (WIDTH - 1)
            before += classes * WIDTH**j
    classes = np.where(head, heads >> (_BITS * shape.head_depth), HEAD_CLASSES + (buckets >> (_BITS * shape.tail_depth)))
    return classes, nodes, branches, np.where(head, -1, buckets)


def _inner(nodes: np.ndarray, branches: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
    """Level by level the tokens that go on there, their nodes and branches."""
    for level, branch in zip(nodes, branches, strict=True):
        node = level.take(numbers)
        if node.min() >= 0:
            yield slice(None), node, branch.take(numbers)
        elif node.max() >= 0:
            inner = np.flatnonzero(node >= 0)
            yield inner, node[inner], branch.take(numbers[inner])


def _logits(bias: np.ndarray, node: np.ndarray | None, own: list[np.ndarray], some: slice) -> np.ndarray:
    """A row per token of a step, a column per branch; a row's greatest is taken off where sums of exp could leave float32's range.

    ``bias`` is one for all, or one per token, or one per node."""
    if bias.ndim > 1:
        bias = bias[some] if node is None else bias.take(node[some], axis=0)
    logits = own[0] + bias
    for weights in own[1:]:
        logits += weights
    if max(logits.max(), -logits.min()) > SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _log_of(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray, target: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities of the targets, made in steps that stay in the cache."""
    out, ones = np.empty(len(rows)), np.ones(weights.shape[1], dtype=np.float32)
    for begin in range(0, len(rows), STEP):
        some = slice(begin, begin + STEP)
        logits = _logits(bias, node, [weights.take(r, axis=0) for r in rows[some].T], some)
        own = logits[np.arange(len(logits)), target[some]].astype(np.float64)
        out[some] = own - np.log(np.exp(logits, out=logits) @ ones)
    return out


def _rows(hashes: np.ndarray, table: int, nodes: np.ndarray | None = None) -> np.ndarray:
    if nodes is not None:
        hashes = _mixed(hashes ^ _mixed(nodes.astype(np.uint64) + _U(77))[:, None])
    return (hashes & _U(table - 1)).astype(np.int64)


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in use, how often each is, and where its tokens start; all tokens, row by row; for every token and kind whether it has the row alone."""
    n, kinds = rows.shape
    bits, kind_bits = n.bit_length(), kinds.bit_length()
    use = (np.arange(kinds)[:, None] << bits) | np.arange(n)
    keys = ((rows.T << (bits + kind_bits)) | use).reshape(-1)
    keys.sort()
    row, use = keys >> (bits + kind_bits), keys & ((1 << (bits + kind_bits)) - 1)
    starts = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
    times = np.diff(starts, append=rows.size)
    alone = np.zeros((kinds, 1 << bits), dtype=bool)
    alone.reshape(-1)[use[starts[times == 1]]] = True
    return row[starts], times, starts, use & ((1 << bits) - 1), alone


def _learn(bias: np.ndarray, weights: np.ndarray, used: np.ndarray, rows: np.ndarray, target: np.ndarray, node: np.ndarray | None = None) -> None:
    """One gradient step of a mini-batch, scaled by how often a row is used as its curvature grows with that."""
    rate = lambda n: np.float32(RATE / (0.25 * n + 1))
    touched, times, starts, tokens, alone = _grouped(rows)
    used[touched] += times
    width = weights.shape[1]
    slope, ones = np.empty((len(rows), width), dtype=np.float32), np.ones(width, dtype=np.float32)
    for begin in range(0, len(rows), STEP):
        some = slice(begin, begin + STEP)
        own = [weights.take(r, axis=0) for r in rows[some].T]
        logits = _logits(bias, node, own, some)
        np.exp(logits, out=logits)
        part = np.divide(logits, (logits @ ones)[:, None], out=slope[some])
        part.reshape(-1)[np.arange(0, part.size, width) + target[some]] -= 1
        for r, before, one in zip(rows[some].T, own, alone[:, some], strict=True):  # no other token has these rows
            one = np.flatnonzero(one[: len(r)])
            moved = part.take(one, axis=0)
            moved *= rate(1)
            weights[r[one]] = np.subtract(before.take(one, axis=0), moved, out=moved)
    # all other rows, the most used first: the first use of each, then the second of those used twice, and so on
    shared = np.flatnonzero(times > 1)
    rarity = (OFTEN - np.minimum(times[shared], OFTEN)).astype(np.uint8)
    order = np.argsort(rarity, kind="stable")
    touched, times, starts = (x[shared[order]] for x in (touched, times, starts))
    moved = slope.take(tokens[starts], axis=0)
    beyond = np.searchsorted(rarity[order], np.arange(OFTEN, 0, -1, dtype=np.uint8)).tolist()  # rows used more often than this
    many = beyond[-1]
    for i, (start, n) in enumerate(zip(starts[:many].tolist(), times[:many].tolist(), strict=True)):  # summed whole
        moved[i] = slope.take(tokens[start : start + n], axis=0).sum(axis=0, dtype=np.float64) * rate(n)
    for use in range(1, OFTEN):
        moved[beyond[use] : beyond[use - 1]] *= rate(use)
        some = slice(many, beyond[use])
        if some.start == some.stop:
            break
        moved[some] += slope.take(tokens[starts[some] + use], axis=0)
    weights[touched] = np.subtract(weights.take(touched, axis=0), moved, out=moved)


def _trained(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How far this task's blocks move the weights, times the uses of every row, and the uses."""
    tables = [model.class_weights.copy(), model.head_weights.copy()]
    size = model.shape.table
    used = [np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)]
    for _, doc_ids, split in blocks_of(batches, _read):
        t = _tokens(doc_ids, *split)
        classes, nodes, branches, _ = _places(model, t)
        own = np.flatnonzero(np.repeat(t.training, t.lengths))
        parts = max(1, len(own) // BATCH)
        hashes = features(t)
        for part in range(parts if len(own) else 0):  # every part takes tokens from all over the block
            h, n = hashes.take(own[part::parts], axis=0), t.numbers.take(own[part::parts])
            _learn(model.class_bias, tables[0], used[0], _rows(h, size), classes[n])
            for inner, node, branch in _inner(nodes, branches, n):
                _learn(model.inner_bias, tables[1], used[1], _rows(h[inner], size, node), branch, node)
    if not any(u.any() for u in used):
        return
    for number, (before, after, uses) in enumerate(zip([model.class_weights, model.head_weights], tables, used, strict=True)):
        places, chunks = [], []
        for i in range(0, size, CHUNK):
            some, weight = slice(i, i + CHUNK), uses[i : i + CHUNK, None]
            if weight.any():
                places.append(number * (size // CHUNK) + i // CHUNK)
                chunks.append(np.concatenate([(after[some] - before[some]) * weight, weight], axis=1).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "moved"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("moved").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "moved": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def fit(blocks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` rounds of distributed steps. The driver gets one table of weights per round."""
    per_table = model.shape.table // CHUNK
    per_task = BLOCKS_PER_TASK * max(1, model.shape.table // TASK_TABLE)
    context, tasks = blocks.sparkSession.sparkContext, max(1, blocks.count() // per_task)
    salts = max(1, round(tasks**0.5))
    for r in range(rounds):
        shared = context.broadcast(model)
        own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r).coalesce(tasks)
        moves = own.mapInArrow(lambda batches: _trained(batches, shared.value), "chunk int, moved binary")  # noqa: B023
        salted = moves.withColumn("salt", F.spark_partition_id() % salts)
        once = salted.groupBy("chunk", "salt").applyInArrow(lambda key, t: _added(t.select(["chunk", "moved"])), "chunk int, moved binary")
        sums = once.groupBy("chunk").applyInArrow(_added, "chunk int, moved binary").toArrow()
        model.class_weights, model.head_weights = model.class_weights.copy(), model.head_weights.copy()
        for chunk, moved in zip(sums.column("chunk").to_pylist(), sums.column("moved"), strict=True):
            number, i = divmod(chunk, per_table)
            table = (model.class_weights, model.head_weights)[number]
            whole = np.frombuffer(moved.as_py(), np.float32).reshape(CHUNK, -1)
            table[i * CHUNK : (i + 1) * CHUNK] += whole[:, :-1] / np.maximum(whole[:, -1:], 1)
        shared.unpersist()
    return model


def log10_of(model: Model, t: Tokens, counts: np.ndarray) -> np.ndarray:
    """The model's log10 probability of every token, given the training counts of the vocabulary."""
    classes, nodes, branches, buckets = _places(model, t)
    tail = np.maximum(buckets, 0)
    share = np.log((counts + SMOOTH) / (model.tail_tokens[tail] + SMOOTH * (model.tail_types[tail] + 1)))
    share[buckets < 0] = 0
    out, hashes, size = np.empty(len(t.numbers)), features(t), model.shape.table
    for begin in range(0, len(out), BATCH):
        part = slice(begin, begin + BATCH)
        n, h = t.numbers[part], hashes[part]
        score = _log_of(model.class_bias, model.class_weights, _rows(h, size), classes[n]) + share[n]
        for inner, node, branch in _inner(nodes, branches, n):
            score[inner] += _log_of(model.inner_bias, model.head_weights, _rows(h[inner], size, node), branch, node)
        out[part] = score / np.log(10)
    return out


def _scored(model, shards: int):
    def apply(block: int, doc_ids: list, split: tuple, answers: pa.Table) -> pa.Table:
        own, t = model.value, _tokens(doc_ids, *split)
        told = dict(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        counts = np.zeros(len(t.vocabulary), dtype=np.int64)
        for shard, words in _by_shard(t, shards):
            counts[words] = np.frombuffer(told[shard], np.int64)
        base = np.log10((counts + SMOOTH) / (own.train_tokens + SMOOTH * (own.train_types + 1)))
        begin = np.cumsum(t.lengths) - t.lengths
        sums = lambda x: np.add.reduceat(x, begin)
        columns = (doc_ids, ~t.training, t.lengths, sums((counts > 0)[t.numbers].astype(np.int64)), np.full(len(doc_ids), own.train_tokens), sums(base[t.numbers]), sums(log10_of(own, t, counts)))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return apply


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row with its token counts, its unigram score and the model's score."""
    blocks = pack(docs.select("doc_id", "text"), write=_write)
    shards = shard_count(blocks)
    sent = blocks.mapInArrow(lambda batches: _sent(batches, shards), MESSAGE)
    answers = kept(sent.groupBy("shard").applyInArrow(_summed, ANSWER), "lm-counts")
    shape = Shape.of(int(totals_of(answers, 0)[TAIL_CLASSES:].sum()))
    ranked = answers.select(F.explode("heads").alias("h")).select("h.word", "h.n").orderBy(F.col("n").desc(), "word").limit(shape.heads).collect()
    heads = [(bytes(r["word"]), r["n"]) for r in ranked]
    if END not in dict(heads):  # the end is always told apart
        end = answers.select(F.explode("heads").alias("h")).where(F.length("h.word") == 0).select("h.n").collect()
        heads = [*heads[: shape.heads - 1], *[(END, r["n"]) for r in end]]
    model = fit(blocks, Model.of_counts(heads, totals_of(answers, shape.tail_depth), shape), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return answered(blocks, answers.select("block", "shard", "counts"), _scored(shared, shards), RESULT, _read)
