"""Licence matches against a search of every place for every template."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import licenses
from assayer.llm.queries import QUERIES
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def base_places(words):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    return [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def brute(index, text):
    """Every start is tried: how many of the looked-up words stand there, then keys and share."""
    words, found = plain_words(text), []
    for laid in index.laid:
        if laid.template.phrase:
            continue
        own = [w.decode() for w in laid.words]
        looked_up = [w.decode() for w in laid.rarest if w.decode() in words][: licenses.RARE]
        for start in range(-len(own), len(words)):
            def near(p):
                return words[max(0, start + p) : max(0, start + p + licenses.SLACK + 1)]

            agreeing = sum(any(w in near(p) for p, o in enumerate(own) if o == w) for w in looked_up)
            exact = any(0 <= start + p < len(words) and words[start + p] == o for p, o in enumerate(own) if o in looked_up)
            part = " ".join(words[max(0, start) : max(0, start + len(own) + licenses.SLACK)])
            if not exact or agreeing < laid.agreeing or not all(f" {' '.join(k.decode() for k in key)} " in f" {part} " for key in laid.keys):
                continue
            weight = [laid.weight[w] for w in laid.words]
            share = sum(x for p, x in enumerate(weight) if own[p] in near(p)) / sum(weight)
            if share >= licenses.LEAST_SHARE:
                found.append((laid.template.label, share))
    return found


def made_texts(seed=4, n=160):
    rng = random.Random(seed)
    filler = ["the", "license", "version", "under", "été", "of", "mit", "public", "general", "2", "0", "work", "apache", "zebra"]
    texts = [None, "", "...", "MIT License", "mit\x00LICENSE apache-license", "license mit"]
    for _ in range(n):
        parts = [rng.choice(filler) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            notice = plain_words(rng.choice(licenses.TEMPLATES).text)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(3)
            place = rng.randrange(len(parts) + 1)
            parts[place:place] = notice
        texts.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in parts))
    return texts


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x180))) + "aÉ日-本_x9"
    assert [w.decode() for w in licenses.words_of(text.encode())] == plain_words(text)


def test_every_place_against_brute_force(spark):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for name in ("matches", "n_words", "word", "n", "label"):
        docs = docs.withColumn(name, F.lit("x"))
    index = licenses.index_of(docs)
    got = {r.doc_id: r for r in licenses.report(docs).collect()}
    assert len(got) == len(texts) and sum(bool(brute(index, t)) for t in texts) > 40
    for i, text in enumerate(texts):
        row, words = got[i], plain_words(text)
        base, notices = base_places(words), brute(index, text)
        places = [p for p, _ in base]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(base), min(places, default=None), max(places, default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in base}))
        assert row.labels == ",".join(sorted({label for _, label in base} | {label for label, _ in notices}))
        best = max((s for _, s in notices), default=licenses.PHRASE_SCORE if base else 0.0)
        assert row.score == pytest.approx(min(1.0, best)) and 0 <= row.score <= 1


def test_rarity_is_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, "mit license" if i % 4 == 0 else "license license") for i in range(40)], "doc_id int, text string").repartition(5)
    index = licenses.index_of(docs)
    mit = index.laid[0]
    assert mit.rarest == [b"mit", b"license"]
    assert mit.weight[b"mit"] == pytest.approx(np.log(42 / 11)) and mit.weight[b"license"] == pytest.approx(np.log(42 / 41))


def test_a_notice_survives_small_edits_only(spark):
    notice = licenses.NOTICES[0].text
    edited = notice.replace("free of charge,", "free of charge, as a gift,")
    without_key = notice.replace("free of charge", "for a fee")
    shuffled = " ".join(sorted(notice.split()))
    docs = spark.createDataFrame(list(enumerate([f"x y {notice} z", edited, without_key, shuffled, f"{notice} {notice}", "license " * 50_000 + notice])), "doc_id int, text string")
    found = {r.doc_id: [(m.label, m.start) for m in r.matches] for r in licenses.scan(docs).collect()}
    n = len(plain_words(notice))
    assert found == {0: [("mit-grant", 2)], 1: [("mit-grant", 0)], 2: [], 3: [], 4: [("mit-grant", 0), ("mit-grant", n)], 5: [("mit-grant", 50_000)]}


def test_given_and_corner_tables(spark, corner_dir):
    for folder in (corner_dir, DATA):
        rows = QUERIES["op13_license_scan"](spark, folder).collect()
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        base = lambda ws: (len(ws), len(base_places(ws)), ",".join(sorted({x for _, x in base_places(ws)})))
        got = sorted((str(r.doc_id), r.n_words, r.n_base, r.base_labels) for r in rows)
        assert got == sorted((str(r.doc_id), *base(plain_words(r.text))) for r in texts)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
