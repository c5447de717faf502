"""Documents packed into blocks, and messages between blocks and shards of a key space.

A block is one row with some megabytes of documents. Work that needs facts about all documents (how
often a word occurs, who has a phrase first) runs in three steps: every block sends each shard what it
holds of the shard's keys, already reduced within the block; a shard answers every block in the order
of what the block sent; the block applies the answers to its documents. A key that is everywhere so
costs one entry per block, not one per document. Blocks are written once, so a lost task finds the same
documents in the same order again. Their texts are one compressed value, which is also what moves when
answers are brought to the blocks; a caller may write something else made of the texts and read that back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assayer.session import run_dir

#: Bytes of the texts of a block; a longer document is a block of its own.
BLOCK_BYTES = 3_000_000
#: Shards there are at least, and shards per block beyond.
LEAST_SHARDS, BLOCKS_PER_SHARD = 64, 4
BLOCK = "block bigint, doc_ids array<bigint>, sizes array<int>, body binary"
_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary())])


#: What is written of a block's texts, a size for each and a body, and what is read back from them.
Write = Callable[[list[bytes]], tuple[list[int], bytes]]
Read = Callable[[list[int], bytes], Any]


def _joined(texts: list[bytes]) -> tuple[list[int], bytes]:
    return [len(t) for t in texts], zstandard.ZstdCompressor(level=5).compress(b"".join(texts))


def _cut(sizes: list[int], body: bytes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(body)
    ends = np.cumsum(sizes).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _packed(batches: Iterator[pa.RecordBatch], limit: int, write: Write) -> Iterator[pa.RecordBatch]:
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def row():
        columns = ([number], [ids], *([x] for x in write(texts)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = (text or "").encode("utf-8")
            if ids and size + len(text) > limit:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if ids:
        yield row()


def pack(docs: DataFrame, limit: int = BLOCK_BYTES, write: Write = _joined) -> DataFrame:
    """The documents (doc_id, text) as a written table of blocks; NULL texts become empty."""
    path = run_dir(docs.sparkSession, "blocks")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    rows.mapInArrow(lambda batches: _packed(batches, limit, write), BLOCK).write.parquet(path)
    return docs.sparkSession.read.schema(BLOCK).parquet(path)


def shard_count(blocks: DataFrame) -> int:
    """Shards grow with the blocks, so that what one shard holds stays about the same."""
    return max(LEAST_SHARDS, blocks.count() // BLOCKS_PER_SHARD)


def blocks_of(rows: Iterable[pa.RecordBatch | pa.Table], read: Read = _cut) -> Iterator[tuple[int, list[int | None], Any]]:
    """Blocks as (block, doc_ids, texts in UTF-8 or what ``read`` makes of them)."""
    for batch in rows:
        for i in range(batch.num_rows):
            block, doc_ids, sizes, body = (batch.column(name)[i].as_py() for name in _BLOCK.names)
            yield block, doc_ids, read(sizes, body)


def answered(blocks: DataFrame, answers: DataFrame, apply: Callable[[int, list, Any, pa.Table], pa.Table], schema: str, read: Read = _cut) -> DataFrame:
    """Every block together with the answers to it: ``apply(block, doc_ids, texts, answers)`` makes its rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([apply(*block, right) for block in blocks_of([left], read)])

    cogrouped = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return cogrouped.applyInArrow(run, schema)
