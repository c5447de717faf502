"""Near-duplicates: signatures estimate the weighted Jaccard, classes equal brute force."""

import random
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from assayer.llm import near
from assayer.llm.components import components

SCHEMA = "doc_id bigint, text string"


def brute(docs, least=near.SIMILARITY):
    counted = near.bags([t for _, t in docs])
    holders = defaultdict(set)
    for i, (h, _) in enumerate(counted):
        for x in h.tolist():
            holders[x].add(i)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in set().union(*[holders[x] for x in counted[i][0].tolist()]):
            if j < i and near.weighted_jaccard(counted[i], counted[j]) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(i)
    out = []
    for m in members.values():
        ids = [docs[i][0] for i in m if docs[i][0] is not None]
        out += [(docs[i][0], min(ids) if ids else None, len(m)) for i in m]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in near.classes(frame).collect()), key=str)


def made():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    docs = []
    for c in range(12):
        text = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.randrange(1, 12)):  # a chain: each a little further from the first
            if rng.random() < 0.7 and len(text) > 30:
                text = list(text)
                text[rng.randrange(len(text))] = word()
            docs.append((len(docs) * 3 % 101, " ".join(text).upper() if c % 3 == 0 else " ".join(text)))
    repeat = [word() for _ in range(20)]
    docs += [(200, " ".join(repeat * 10)), (201, " ".join(repeat * 11)), (202, " ".join(repeat * 3)), (203, "one two"), (204, "ONE  two\n"), (205, "one two three")]
    docs += [(300, None), (301, ""), (302, " \n"), (None, docs[0][1]), (None, None), (None, "alone with no id at all"), (7, docs[5][1]), (7, docs[5][1]), (400, "long text " * 20_000)]
    return docs


def test_classes_equal_brute_force(spark, monkeypatch):
    docs = made()
    want = brute(docs)
    assert got(spark.createDataFrame(docs, SCHEMA + "").repartition(3)) == want
    extra = spark.createDataFrame([(*d, 1, b"x") for d in docs], SCHEMA + ", bucket int, node binary")
    monkeypatch.setattr(near, "BLOCK_NODES", 3)
    assert got(extra) == want


def test_pairs_missed_by_the_pivot_are_found(spark, monkeypatch):
    """Variants of one text, some of which are only similar to each other; blocks of a bucket are tiny."""
    monkeypatch.setattr(near, "BLOCK_NODES", 4)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(40):
        text = list(base)
        for _ in range(i % 5 + 1):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    assert got(spark.createDataFrame(docs, SCHEMA)) == brute(docs)


def test_similar_pairs_are_exact():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    counted = near.bags(texts)
    rows, columns = np.arange(0, 60, 2), np.arange(60)
    want = {(i, j) for i in rows.tolist() for j in columns.tolist() if i != j and near.weighted_jaccard(counted[i], counted[j]) >= 0.3}
    assert set(near.similar(counted, rows, columns, 0.3)) == want


def test_signatures_are_unbiased():
    rng = random.Random(1)
    texts, words = [], [f"w{i}" for i in range(3000)]
    for _ in range(150):
        a = [rng.choice(words) for _ in range(rng.choice([8, 30, 200]))]
        b = [rng.choice(words) if rng.random() < 0.03 else w for w in a]
        times = rng.choice([(1, 1), (3, 2), (1, 4)])
        texts += [" ".join(a * times[0]), " ".join(b * times[1])]
    counted = near.bags(texts)
    signed = near.signatures(counted)
    error = [(signed[i] == signed[i + 1]).mean() - near.weighted_jaccard(counted[i], counted[i + 1]) for i in range(0, len(texts), 2)]
    assert abs(np.mean(error)) < 0.015
    assert np.sqrt(np.mean(np.square(error))) < 0.06
    assert near.signatures([]).shape == (0, near.COMPONENTS)


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert dict(tuple(r) for r in components(frame).collect()) == want


def test_keep_one(spark, corner_dir):
    docs = spark.read.parquet(f"{corner_dir}/documents.parquet")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    first = {d for d, c, _ in brute(rows) if d is not None and d == c}
    assert {r.doc_id for r in kept.collect()} - {None} == first
    # A row a class: those with the words of a class once, those without words all.
    left = [r.text for r in kept.collect()]
    assert len([t for t in left if not (t or "").split()]) == len([t for _, t in rows if not (t or "").split()])
    worded = [r for r in rows if (r[1] or "").split()]
    assert len([t for t in left if (t or "").split()]) == len(set(brute_labels([t for _, t in worded])))


def brute_labels(texts):
    """Classes of texts, whatever their ids."""
    found = brute(list(enumerate(texts)))
    return [c for _, c, _ in found]


def test_keep_one_by_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(40))
    close = long + " tail"
    rows = [(1, long, "a"), (5, close, "b"), (5, "a text of its own that nobody else has at all", "c"), (None, long, "d"), (6, "same words here again and again", "e"), (6, "same words here again and again", "f")]
    rows += [(None, "copies without an id are one class as well", None)] * 3 + [(7, None, "g"), (7, "", "h"), (7, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, near_id string")
    for name in ("_gone", "near_print", "near_row", "n", "label", "print", "row", "stays"):
        docs = docs.withColumn(name, F.lit(name))
    out = near.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, long), (5, rows[2][1]), (6, rows[4][1]), (None, rows[6][1]), (7, None), (7, ""), (7, "")]
    assert got == sorted(want, key=str)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Families that share a bucket: refused nodes are compared with all, in blocks of two nodes."""
    monkeypatch.setattr(near, "BLOCK_NODES", 2)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    families = [common + [f"f{k}_{i}" for i in range(40)] for k in range(4)]
    texts = []
    for family in families:
        for _ in range(5):
            own = list(family)
            for _ in range(2):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near.classes(frame).collect())
    assert got == sorted(brute(rows))
