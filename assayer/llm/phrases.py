"""Substring dedup: words of passages that an earlier document has already.

A window is SIZE consecutive words. A word goes if a window that covers it also starts in a document
with a smaller id. Which windows recur is settled by sharded Aho-Corasick automata:

1. Every window has an anchor, the smallest hash among its runs of ANCHOR words. Equal windows have
   equal anchors, and neighbouring windows mostly share theirs. A block sends each shard its distinct
   anchors with how many windows have them; the shard tells it which of them other blocks have too, and
   which are hot, with more windows than one automaton takes.
2. Of the anchors that recur, the block sends the shard the stretches of text whose windows have them,
   each window once, with the id of the block's first document that has it. Windows of hot anchors go one
   by one, each to a shard chosen by the hash of the whole window, so that no group is beyond a bound.
3. The shard confirms which windows recur word by word, compiles automata of those phrases with the
   smallest id as their value, a bounded number at a time, and streams the stretches through them to
   find every occurrence. It answers each block with one bit per window: an earlier document has it.
4. The block removes the words of those windows, and of those its own earlier documents have.

So a phrase that is in a third of all documents reaches its shard once per block. A single automaton of
all phrases would need about 70 nodes per window; sharding by anchor lets every stretch meet only the
phrases it can contain.

NULL and empty texts have no words; texts below SIZE words have no windows. Rows without an id come
after all others; rows with the same id do not remove each other's words. Repeated rows are kept as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.blocks import answered, blocks_of, pack, shard_count
from assayer.llm.text import kept

SIZE = 13
ANCHOR = 5
#: Phrases compiled into one automaton.
PHRASES = 20_000
#: Windows of one anchor in one block that are not counted further: the anchor is hot.
MANY = 255
LAST = np.iinfo(np.int64).max

_U = np.uint64
_STEP, _OTHER = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
SENT = "shard int, block bigint, anchors binary"
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("anchors", pa.binary())])
STRETCHES = "shard int, block bigint, anchors binary, firsts binary, text binary"
_STRETCHES = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("anchors", pa.binary()), ("firsts", pa.binary()), ("text", pa.binary())])
ANSWER = "block bigint, shard int, bits binary"
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("bits", pa.binary())])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _rolled(hashes: np.ndarray, size: int, step: np.uint64) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * step + hashes[j : j + n]
    out ^= out >> _U(29)
    out *= _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    made, out = 1, values
    while 2 * made <= width:
        out, made = np.minimum(out[:-made], out[made:]), 2 * made
    rest = width - made
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Windows:
    """The windows of a block. Documents are in the order of their ids."""

    order: np.ndarray  # documents as they come
    ids: np.ndarray  # their ids, ascending
    ends: np.ndarray  # where their words end
    tokens: np.ndarray  # the number of every word
    vocabulary: list[bytes]
    starts: np.ndarray  # windows
    owner: np.ndarray  # document of every window
    first: np.ndarray  # index among starts of the first equal window
    runs: np.ndarray  # (from, to) among ``fresh``: stretches of first windows with one anchor
    fresh: np.ndarray  # indexes of first windows, ascending
    anchors: np.ndarray  # of every run
    wholes: np.ndarray  # hashes of first windows


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of all texts as numbers, what the numbers stand for, and the words of every text."""
    split = [t.split() for t in texts]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    numbers = _Ids()
    tokens = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(lengths.sum()))
    return tokens, list(numbers), lengths


def placed(tokens: np.ndarray, vocabulary: list[bytes], lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, where texts end, where windows start, and the text of every word."""
    digests = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
    ends, document = np.cumsum(lengths), np.repeat(np.arange(len(lengths)), lengths)
    n = max(0, len(tokens) - size + 1)
    return digests[tokens], ends, np.flatnonzero(np.arange(n) + size <= ends[document[:n]]), document


def anchors_of(hashes: np.ndarray, size: int, anchor: int) -> np.ndarray:
    """The anchor of the window at every place, were there one."""
    return _least(_rolled(hashes, anchor, _STEP), size - anchor + 1)


def windows_of(doc_ids: list[int | None], texts: list[bytes], size: int = SIZE, anchor: int = ANCHOR) -> Windows:
    ids = np.array([LAST if d is None else d for d in doc_ids], dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    tokens, vocabulary, lengths = numbered([texts[i] for i in order])
    hashes, ends, starts, document = placed(tokens, vocabulary, lengths, size)
    owner = document[starts]
    if not len(starts):
        none = np.empty(0, np.int64)
        return Windows(order, ids[order], ends, tokens, vocabulary, starts, owner, none, none.reshape(0, 2), none, *[none.astype(np.uint64)] * 2)
    whole = _rolled(hashes, size, _OTHER)[starts]
    _, at, back = np.unique(whole, return_index=True, return_inverse=True)
    first = at[back]
    again = np.flatnonzero(first != np.arange(len(first)))
    if len(again) and any((tokens[starts[again] + j] != tokens[starts[first[again]] + j]).any() for j in range(size)):
        rows = np.stack([tokens[starts + j] for j in range(size)], axis=1)  # two windows share a hash: compare the words
        _, at, back = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        first = at[back.reshape(-1)]
    fresh = np.flatnonzero(first == np.arange(len(first)))
    least = anchors_of(hashes, size, anchor)[starts[fresh]]
    breaks = np.flatnonzero((np.diff(starts[fresh]) != 1) | (np.diff(least) != 0)) + 1
    begin = np.concatenate([[0], breaks])
    runs = np.stack([begin, np.concatenate([breaks, [len(fresh)]])], axis=1)
    return Windows(order, ids[order], ends, tokens, vocabulary, starts, owner, first, runs, fresh, least[begin], whole[fresh])


def _by_shard(anchors: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of every shard's anchors in the order they are sent; the answers come in the same order."""
    shard = (anchors % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.unique(shard):
        yield int(s), order[edges[s] : edges[s + 1]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _flags(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)


def _sent(batches: Iterator[pa.RecordBatch], shards: int, size: int) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of every block, the upper six bytes of each, and the windows that have it, up to MANY."""
    for block, _, texts in blocks_of(batches):
        hashes, _, starts, _ = placed(*numbered(texts), size)
        own, times = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(starts):
            every = anchors_of(hashes, size, ANCHOR)[starts]
            begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))  # neighbours mostly share theirs
            own, back = np.unique(every[begin], return_inverse=True)
            times = np.bincount(back, np.diff(begin, append=len(every)))
        short = own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7].copy()
        short[:, 6] = np.minimum(times, MANY)
        yield _batch([(shard, block, short[at].tobytes()) for shard, at in _by_shard(own, shards)], _SENT)


def _met(table: pa.Table, most: int) -> pa.Table:
    """For every block that sent anchors to this shard, a bit per anchor: another block has it too; then another: over ``most`` windows have it."""
    sent = [np.frombuffer(x, np.uint8).reshape(-1, 7) for x in table.column("anchors").to_pylist()]
    all_sent = np.concatenate(sent)
    every = np.zeros((len(all_sent), 8), dtype=np.uint8)
    every[:, 2:] = all_sent[:, :6]
    _, number, times = np.unique(every.view(">u8").reshape(-1).astype(np.uint64), return_inverse=True, return_counts=True)
    windows = np.bincount(number, np.where(all_sent[:, 6] == MANY, most + 1, all_sent[:, 6]))
    cuts = np.cumsum([len(x) for x in sent])[:-1]
    bits = [np.packbits(np.concatenate(x)).tobytes() for x in zip(np.split(times[number] > 1, cuts), np.split(windows[number] > most, cuts), strict=True)]
    return pa.table([table.column("block"), table.column("shard"), pa.array(bits, pa.binary())], schema=_ANSWER)


def _recurring(w: Windows, bits: dict[int, bytes], shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs whose anchors other blocks have too, by shard, in the order they are sent, and what groups them: (shard, runs, keys).

    Runs of hot anchors are cut into windows and go to shards of their own, numbered from ``shards``."""
    own, back = np.unique(w.anchors, return_inverse=True)
    again, hot = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    for shard, at in _by_shard(own, shards):
        if shard in bits:
            again[at], hot[at] = _flags(bits[shard], 2 * len(at)).reshape(2, -1)
    cold = np.flatnonzero((again & ~hot)[back]) if len(own) else np.empty(0, np.int64)
    for shard, at in _by_shard(w.anchors[cold], shards):
        yield shard, w.runs[cold[at]], w.anchors[cold[at]]
    split = w.runs[(again & hot)[back]] if len(own) else w.runs
    single = np.concatenate([np.arange(a, b) for a, b in split]) if len(split) else np.empty(0, np.int64)
    for shard, at in _by_shard(w.wholes[single], shards):
        yield shards + shard, np.stack([single[at], single[at] + 1], axis=1), w.wholes[single[at]]


def _stretched(shards: int, size: int):
    def apply(block: int, doc_ids: list, texts: list, answers: pa.Table) -> pa.Table:
        squeeze, w = zstandard.ZstdCompressor(level=5), windows_of(doc_ids, texts, size)
        told = dict(zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        words, tokens, rows = w.vocabulary, w.tokens.tolist(), []
        for shard, runs, keys in _recurring(w, told, shards):
            begin, end = w.fresh[runs[:, 0]], w.fresh[runs[:, 1] - 1]
            stretches = [b" ".join([words[t] for t in tokens[a : b + size]]) for a, b in zip(w.starts[begin].tolist(), w.starts[end].tolist(), strict=True)]
            firsts = np.diff(w.ids[w.owner[begin]], prepend=0)
            rows.append((shard, block, keys.tobytes(), squeeze.compress(firsts.tobytes()), squeeze.compress(b"\n".join(stretches))))
        return pa.Table.from_batches([_batch(rows, _STRETCHES)])

    return apply


class _Letters(dict):
    """Words to one character each, so that an automaton has a node per word of a phrase."""

    def __missing__(self, word: bytes) -> str:
        number = len(self)
        letter = self[word] = chr(number if number < 0xD800 else number + 0x800)
        return letter


def _settled(table: pa.Table, size: int, phrases: int) -> pa.Table:
    """Bits for every block that sent something to this shard: an earlier document has the window."""
    n, expand = table.num_rows, zstandard.ZstdDecompressor()
    anchors = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
    firsts = [np.cumsum(np.frombuffer(expand.decompress(x), np.int64)) for x in table.column("firsts").to_pylist()]
    stretches = [expand.decompress(x).split(b"\n") for x in table.column("text").to_pylist()]
    counts = [[t.count(b" ") + 2 - size for t in texts] for texts in stretches]
    sizes = [len(a) for a in anchors]
    row = np.repeat(np.arange(n), sizes)
    entry = np.concatenate([np.arange(k) for k in sizes])
    every, all_first = np.concatenate(anchors), np.concatenate(firsts)
    order = np.lexsort((all_first, every))
    group = np.cumsum(np.concatenate([[0], (np.diff(every[order]) != 0).astype(np.int64)]))
    offsets = [np.concatenate([[0], np.cumsum(c)]).astype(np.int64) for c in counts]
    bits = [np.zeros(int(o[-1]), dtype=np.uint8) for o in offsets]

    def settle(members: list[int]) -> None:
        letters, whose = _Letters(), {}
        for m in members:  # by anchor, then by id: the first to bring a stretch or a phrase has the smallest id
            whose.setdefault(stretches[row[m]][entry[m]], []).append(m)
        seen: dict[str, int] = {}
        confirmed: dict[str, int] = {}
        spelled = []
        for stretch, owners in whose.items():
            text, who = "".join(map(letters.__getitem__, stretch.split(b" "))), int(all_first[owners[0]])
            spelled.append((text, owners))
            for i in range(len(text) - size + 1):
                phrase = text[i : i + size]
                first = seen.setdefault(phrase, who)
                if first != who or len(owners) > 1:
                    confirmed[phrase] = first
        if not confirmed:
            return
        automaton = ahocorasick.Automaton()
        for phrase, who in confirmed.items():
            automaton.add_word(phrase, who)
        automaton.make_automaton()
        for text, owners in spelled:
            found = [(end - size + 1, who) for end, who in automaton.iter(text)]
            for m in owners:
                own, begin = int(all_first[m]), offsets[row[m]][entry[m]]
                for place, who in found:
                    if who < own:
                        bits[row[m]][begin + place] = 1

    begin, held = 0, 0
    members = order.tolist()
    for i in range(len(members)):
        held += int(counts[row[members[i]]][entry[members[i]]])
        if i + 1 == len(members) or (held >= phrases and group[i + 1] != group[i]):
            settle(members[begin : i + 1])
            begin, held = i + 1, 0
    some = [r for r in range(n) if bits[r].any()]
    blocks, shards = table.column("block").to_pylist(), table.column("shard").to_pylist()
    return pa.Table.from_batches([_batch([(blocks[r], shards[r], np.packbits(bits[r]).tobytes()) for r in some], _ANSWER)])


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def removal(w: Windows, met: dict[int, bytes], answers: dict[int, bytes], shards: int, size: int) -> np.ndarray:
    """Which words of a block go, given the answers of the shards."""
    earlier = np.zeros(len(w.starts), dtype=bool)
    for shard, runs, _ in _recurring(w, met, shards):
        if shard in answers:
            sent = np.concatenate([np.arange(a, b) for a, b in runs])
            earlier[w.fresh[sent]] = _flags(answers[shard], len(sent))
    own = w.ids[w.owner]
    gone = w.starts[earlier[w.first] | (own > own[w.first])] if len(w.starts) else w.starts
    change = np.zeros(len(w.tokens) + 1, dtype=np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + size, -1)
    return np.cumsum(change[:-1]) > 0


def _applied(shards: int, size: int):
    def apply(block: int, doc_ids: list, texts: list, answers: pa.Table) -> pa.Table:
        told: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
        for shard, bits, last in zip(*(answers.column(c).to_pylist() for c in ("shard", "bits", "last")), strict=True):
            told[last][shard] = bits
        w = windows_of(doc_ids, texts, size)
        gone = removal(w, *told, shards, size)
        rows, begin = [None] * len(doc_ids), 0
        for place, end in zip(w.order.tolist(), w.ends.tolist(), strict=True):
            own = gone[begin:end]
            words = [w.vocabulary[t] for t in w.tokens[begin:end][~own].tolist()]
            rows[place] = (doc_ids[place], end - begin, int(own.sum()), b" ".join(words).decode("utf-8"))
            begin = end
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return apply


def dedup(docs: DataFrame, size: int = SIZE, phrases: int = PHRASES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed and the kept words joined by one blank."""
    blocks = pack(docs.select("doc_id", "text"))
    shards = shard_count(blocks)
    sent = blocks.mapInArrow(lambda batches: _sent(batches, shards, size), SENT)
    met = kept(sent.groupBy("shard").applyInArrow(lambda table: _met(table, phrases), ANSWER), "phrase-anchors")
    stretches = answered(blocks, met, _stretched(shards, size), STRETCHES)
    settled = kept(stretches.groupBy("shard").applyInArrow(lambda table: _settled(table, size, phrases), ANSWER), "phrase-answers")
    both = met.withColumn("last", F.lit(0)).unionByName(settled.withColumn("last", F.lit(1)))
    return answered(blocks, both, _applied(shards, size), RESULT)
