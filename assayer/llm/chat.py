"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks by prefix sums.

A turn is  TURN role HEAD text END , where the capitals are reserved ids above the vocabulary. Roles and
texts are encoded one by one, so no token spans a border, and a text can never produce a reserved id. For
readers of the rendered text, control strings inside roles and texts are escaped by a backslash and
backslashes are doubled, which ``unescape`` undoes. The loss mask covers the texts of the trained role:
+1 where such a text begins, -1 where it ends, summed up along the tokens.

Rows are ordered by turn (NULL first), ties by role and text. NULL texts and roles are empty. Rows
without a conv_id are one conversation. Rows are encoded before they are grouped; a conversation, which
is one training example, is put together whole. Repeated rows are repeated turns.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tiktoken_ext.openai_public import r50k_pat_str

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Reserved marks and how they are rendered; their ids follow those of the vocabulary.
MARKS = ("### ", ": ", "</turn>\n")
TURN, HEAD, END = range(3)
#: Escaped inside texts and roles.
CONTROL = ("### ", "</turn>")
TRAINED = "assistant"

FORMATTED = "conv_id bigint, n_turns bigint, token_ids array<int>, loss_mask array<boolean>, formatted string"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("formatted", pa.string())])
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, "\\" + control)
    return text


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={})


def reserved(path: str) -> list[int]:
    first = max(encoding(path)._mergeable_ranks.values()) + 1
    return list(range(first, first + len(MARKS)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        encode = encoding(path).encode_ordinary
        heads = [encode(escape_role(r)) for r in roles]
        bodies = [encode(escape(t)) for t in texts]
        columns = [batch.column(i) for i in range(4)] + [pa.array(heads, pa.list_(pa.int32())), pa.array(bodies, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "head", "body"])


def assembled(turns: list[dict], path: str, trained: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of one conversation from its encoded turns."""
    marks = reserved(path)
    pieces, trains = [], []
    for t in turns:
        pieces += [[marks[TURN]], t["head"], [marks[HEAD]], t["body"], [marks[END]]]
        trains += [0, 0, 0, int(t["role"] == trained), 0]
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    change = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    np.add.at(change, ends - lengths, trains)
    np.add.at(change, ends, -np.array(trains))
    ids = np.fromiter((i for p in pieces for i in p), dtype=np.int32, count=int(ends[-1]))
    return ids, np.cumsum(change[:-1]) > 0


def _segments(ids: np.ndarray, path: str) -> Iterator[tuple[int | None, np.ndarray, int]]:
    """(mark that stands before, ids up to the next mark, where they begin)."""
    marks = reserved(path)
    at = np.flatnonzero(ids >= marks[0])
    for begin, end in zip(at, [*at[1:], len(ids)], strict=True):
        yield int(ids[begin]) - marks[0], ids[begin + 1 : end], int(begin) + 1


def decoded(ids: np.ndarray, path: str) -> str:
    return encoding(path).decode_bytes(ids.tolist()).decode("utf-8")


def rendered(ids: np.ndarray, path: str) -> str:
    """The template's text of a token sequence."""
    return "".join(MARKS[mark] + decoded(rest, path) for mark, rest, _ in _segments(ids, path))


def turns_of(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(role, text) of every turn, and the texts under the mask, all unescaped."""
    turns, role = [], ""
    for mark, rest, _ in _segments(ids, path):
        if mark == TURN:
            role = unescape(decoded(rest, path))
        elif mark == HEAD:
            turns.append((role, unescape(decoded(rest, path))))
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return turns, [unescape(decoded(ids[a:b], path)) for a, b in change.reshape(-1, 2)]


def _joined(batches: Iterator[pa.RecordBatch], path: str, trained: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, mask = assembled(turns, path, trained)
            rows.append((conv_id, len(turns), ids, mask, rendered(ids, path)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FORMATTED, strict=True)], schema=_FORMATTED)


def format_chats(rows: DataFrame, path: str = VOCABULARY, trained: str = TRAINED) -> DataFrame:
    """Conversations (conv_id, n_turns, token_ids, loss_mask, formatted) from rows (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    plain = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), empty("role"), empty("text"))
    encoded = plain.mapInArrow(lambda batches: _encoded(batches, path), "conv_id bigint, turn bigint, role string, text string, head array<int>, body array<int>")
    turn = F.struct("turn", "role", "text", "head", "body")
    grouped = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    slim = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["head"].alias("head"), t["body"].alias("body"))).alias("turns"))
    return slim.mapInArrow(lambda batches: _joined(batches, path, trained), FORMATTED)


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    digest = lambda parts: hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()
    for batch in batches:
        rows = []
        for conv_id, ids, mask, text in zip(*(batch.column(c) for c in ("conv_id", "token_ids", "loss_mask", "formatted")), strict=True):
            turns, trained = turns_of(np.array(ids.as_py(), dtype=np.int32), np.array(mask.as_py(), dtype=bool), path)
            rows.append((conv_id.as_py(), len(turns), digest(f"{r}\n{t}\n" for r, t in turns), sum(map(len, trained)), digest(trained), len(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_back(formatted: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """What the token ids and the mask of formatted conversations hold, as counts and digests."""
    return formatted.mapInArrow(lambda batches: _read(batches, path), READ)
