"""Escapes as inverses, borders of the mask, token sequences read back."""

import random

import numpy as np
import pytest

from assayer.llm import chat

PIECES = ["\\", "### ", "</turn>", "</turn>\n", ": ", ":", "\n", "Assistant", "a", "é", "日本", "", " ", "\\### ", "\\\\</turn>", "#", "</", "turn>"]


def texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(8))) for _ in range(n)]


def test_escapes_are_undone_and_hide_control_strings():
    for text in texts():
        for escaped in (chat.escape(text), chat.escape_role(text)):
            assert chat.unescape(escaped) == text
        escaped = chat.escape(text).replace("\\\\", "")
        for control in chat.CONTROL:
            assert control not in escaped.replace("\\" + control, "")


def encoded(turns):
    encode = chat.encoding(chat.VOCABULARY).encode_ordinary
    return [{"role": r, "head": encode(chat.escape_role(r)), "body": encode(chat.escape(t))} for r, t in turns]


def test_turns_come_back_and_the_mask_covers_trained_texts_only():
    rng, words = random.Random(7), texts()
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "a: b", ""]), rng.choice(words)) for _ in range(rng.randrange(1, 7))]
        ids, mask = chat.assembled(encoded(turns), chat.VOCABULARY, "assistant")
        back, trained = chat.turns_of(ids, mask, chat.VOCABULARY)
        assert back == turns
        assert trained == [t for r, t in turns if r == "assistant" and t]
        marks = chat.reserved(chat.VOCABULARY)
        assert not mask[np.isin(ids, marks)].any()
        assert [i for i in ids.tolist() if i >= marks[0]] == marks * len(turns)
        shown = "".join(f"### {chat.escape_role(r)}: {chat.escape(t)}</turn>\n" for r, t in turns)
        assert chat.rendered(ids, chat.VOCABULARY) == shown


def test_a_very_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(20_000)] + [(2, None, None, None), (None, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert got[1].n_turns == 20_000 and got[1].loss_chars == sum(len(t) for _, i, r, t in rows[:20_000] if r == "assistant")
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0) and got[None].loss_chars == 1


@pytest.mark.parametrize("trained", ["assistant", "user", "nobody"])
def test_the_trained_role_is_a_parameter(trained):
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    ids, mask = chat.assembled(encoded(turns), chat.VOCABULARY, trained)
    assert chat.turns_of(ids, mask, chat.VOCABULARY)[1] == [t for r, t in turns if r == trained]
