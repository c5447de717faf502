"""Decontamination against brute force: shared windows, items without id, repeated rows, blocks."""

import random
import re

import pytest

from assayer.llm import decontaminate
from tests.conftest import plan_of


def brute_force(docs, items, size):
    cut = lambda t: re.findall(decontaminate.WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = {}
    for item, text in items:
        w = cut(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, named = cut(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    named |= grams[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("abcdeF") for _ in range(n))
    shared = some(4)
    items = [(i, f"{some(3)}, {shared}" if i % 2 else shared) for i in range(200)] + [(None, some(5)), (200, None), (201, ""), (202, "b a"), (202, some(9))]
    docs = [(i, some(rng.randrange(0, 60))) for i in range(120)]
    docs += [(900 + i, f"x{i} {shared.upper()} y") for i in range(50)] + [docs[3], docs[3], (None, docs[5][1]), (None, None), (7, ""), (8, "z " * 20_000 + shared)]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_report_is_that_of_brute_force(spark, corpus, block):
    docs, items = corpus
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.report(*frames, size=4, block=block).collect()), key=str)
    assert got == brute_force(docs, items, 4)


def test_a_phrase_of_many_items_is_one_window(spark, corpus):
    windows, held = decontaminate.benchmark_windows(spark.createDataFrame(corpus[1], "item_id bigint, text string"), 4)
    assert set(windows.columns) == {"window", "len", "hash", "gram"}
    assert windows.count() == windows.select("gram").distinct().count() < held.count()


def test_texts_are_cut_once(spark, corpus):
    docs, items = corpus
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert "regexp_extract_all" not in plan_of(decontaminate.report(*frames, size=4))
