"""Licence scans by a positional index of rare licence words.

Licence notices are templates: a label, words, and key phrases that must stand in the file. The index
holds, for every licence word, its postings (template, position). How rare a word is, is counted over all
documents (inverse document frequency); the counts of the few hundred licence words are all that reaches
the driver. For a file and a template the file's rarest words of the template are looked up; a place i in
the file and a position p in the template vote for the start i - p. Where enough different words agree on
a start, up to SLACK inserted words apart, the template is laid there: the share of its words that stand
where they should, weighted by rarity, must be large enough and every key phrase must be found inside.

Phrases are templates without slack: all of their words must agree on the start, so that each place where
the words stand consecutively is one match.

Words are runs of characters other than ASCII punctuation, blanks and control characters, with A-Z in
lower case. NULL and empty texts have no words and no matches. Texts are read whole; the work for a file
is linear in its words and in the matches it has. Repeated rows give repeated results. Columns other than
the id and the text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import LOWER, UPPER

#: Rarest words of a template that are looked up in a file, and how many of them must agree on a start.
RARE, AGREEING = 8, 4
#: Words that may stand between the words of a notice.
SLACK = 3
#: Share of a notice, by rarity of its words, that must stand in place.
LEAST_SHARE = 0.75
#: Score of a file in which no notice stands, only a phrase.
PHRASE_SCORE = 0.5
_WORDS = bytes.maketrans((UPPER + "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))).encode("latin-1"), (LOWER + " " * (0x30 + 7 + 6 + 5)).encode())
MATCHES = "doc_id bigint, n_words bigint, matches array<struct<label:string,start:bigint,stop:bigint,share:double,phrase:boolean>>"
_MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64()), ("phrase", pa.bool_())])
_MATCHES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(_MATCH))])


@dataclass(frozen=True)
class Template:
    """A notice, or a phrase, which must stand word for word."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    phrase: bool = False


#: The phrases and the labels they stand for.
PHRASES = (Template("mit", "mit license", phrase=True), Template("apache", "apache license", phrase=True), Template("gpl", "general public license", phrase=True))
#: Openings of public licence notices, as their licences word them.
NOTICES = (
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("mit-notice", "Released under the MIT License", ("under the mit license",)),
    Template("mit-notice", "Licensed under the MIT License", ("under the mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache-2.0-limits", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", ("applicable law", "as is basis")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-fsf", "under the terms of the GNU General Public License as published by the Free Software Foundation", ("general public license", "free software foundation")),
    Template("lgpl-fsf", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license", "free software foundation")),
    Template("agpl-fsf", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license", "free software foundation")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable", ("without any express or implied warranty",)),
    Template("boost-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
)
TEMPLATES = PHRASES + NOTICES


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class _Laid:
    """A template with its words in the order of their rarity."""

    template: Template
    words: list[bytes]
    keys: list[list[bytes]]
    needed: frozenset[bytes]
    weight: dict[bytes, float]
    rarest: list[bytes]
    agreeing: int
    slack: int
    postings: dict[bytes, np.ndarray] = field(default_factory=dict)


class Index:
    """Postings of the templates, and the rarity of their words."""

    def __init__(self, templates: Sequence[Template], found_in: dict[bytes, int], documents: int):
        self.laid: list[_Laid] = []
        for template in templates:
            words = words_of(template.text.encode())
            keys = [words] if template.phrase else [words_of(k.encode()) for k in template.keys]
            distinct = sorted(set(words))
            weight = {w: float(np.log((documents + 2) / (found_in.get(w, 0) + 1))) for w in distinct}
            rarest = sorted(distinct, key=lambda w: (-weight[w], w))
            laid = _Laid(
                template,
                words,
                keys,
                frozenset(w for key in keys for w in key),
                weight,
                rarest,
                len(distinct) if template.phrase else min(AGREEING, len(distinct)),
                0 if template.phrase else SLACK,
            )
            for w in distinct:
                laid.postings[w] = np.array([p for p, other in enumerate(words) if other == w], dtype=np.int64)
            self.laid.append(laid)
        self.vocabulary = frozenset(w for laid in self.laid for w in laid.words)

    def matches(self, words: list[bytes]) -> list[dict]:
        """What stands in a file: by start, then label."""
        present = self.vocabulary.intersection(words)
        candidates = []
        for laid in self.laid:
            looked_up = [w for w in laid.rarest if w in present][: max(RARE, laid.agreeing)]
            if len(looked_up) >= laid.agreeing and laid.needed <= present:
                candidates.append((laid, looked_up))
        if not candidates:
            return []
        wanted = frozenset(w for _, looked_up in candidates for w in looked_up)
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        at = {w: np.array(p, dtype=np.int64) for w, p in places.items()}
        found = []
        for laid, looked_up in candidates:
            votes = [(at[w][:, None] - laid.postings[w][None, :]).reshape(-1) for w in looked_up]
            last = None
            for start in agreed_starts(votes, laid.agreeing, laid.slack).tolist():
                match = _verified(laid, words, start)
                if match is None:
                    continue
                if last is None or start > last + laid.slack:
                    found.append(match)
                    last = start
                elif match["share"] > found[-1]["share"]:  # the same place, laid better
                    found[-1] = match
        return sorted(found, key=lambda m: (m["start"], m["label"], m["stop"]))


def agreed_starts(votes: list[np.ndarray], agreeing: int, slack: int) -> np.ndarray:
    """Starts s, ascending, such that at least ``agreeing`` of the words vote for s ... s + slack, one of them for s."""
    starts = np.concatenate(votes)
    bits = np.repeat(np.uint64(1) << np.arange(len(votes), dtype=np.uint64), [len(v) for v in votes])
    order = np.argsort(starts, kind="stable")
    starts, bits = starts[order], bits[order]
    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - 1))
    starts, bits = starts[first], np.bitwise_or.reduceat(bits, first)
    # A window may begin before the first vote it holds, but one that begins at a vote holds as much.
    together = bits.copy()
    for gap in range(1, slack + 1):
        later = np.searchsorted(starts, starts + gap)
        hit = (later < len(starts)) & (starts[np.minimum(later, len(starts) - 1)] == starts + gap)
        together[hit] |= bits[later[hit]]
    return starts[np.bitwise_count(together) >= agreeing]


def _stands(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def _verified(laid: _Laid, words: list[bytes], start: int) -> dict | None:
    """The template laid at ``start``: None if a key phrase or too many words are missing."""
    low, stop = max(0, start), min(len(words), start + len(laid.words) + laid.slack)
    part = words[low:stop]
    if not all(_stands(key, part) for key in laid.keys):
        return None
    total = held = 0.0
    last = low
    for p, w in enumerate(laid.words):
        total += laid.weight[w]
        place = next((i for i in range(max(0, start + p), min(len(words), start + p + laid.slack + 1)) if words[i] == w), None)
        if place is not None:
            held += laid.weight[w]
            last = max(last, place)
    share = held / total if total else 1.0
    if not laid.template.phrase and share < LEAST_SHARE:
        return None
    return {"label": laid.template.label, "start": low, "stop": last + 1, "share": share, "phrase": laid.template.phrase}


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = defaultdict(int)
    documents = 0
    for batch in batches:
        documents += batch.num_rows
        for text in _texts(batch, 0):
            for w in vocabulary.intersection(words_of(text)):
                counts[w] += 1
    rows = [(None, documents), *sorted(counts.items())]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])


def index_of(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> Index:
    """The templates with the rarity of their words, counted over all documents; at most one row a licence word is collected."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))
    counted = docs.select("text").mapInArrow(lambda batches: _counted(batches, vocabulary), "word binary, n bigint")
    counts = {None if r.word is None else bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    documents = counts.pop(None, 0)
    return Index(templates, counts, documents)


def _scanned(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, found = [], []
        for text in _texts(batch, 1):
            words = words_of(text)
            counts.append(len(words))
            found.append(index.matches(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_MATCH))], schema=_MATCHES)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words and its matches (label, start, stop in words from 0, share, phrase) by start."""
    index = index_of(docs, templates)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _scanned(batches, index), MATCHES)


def report(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per document the places of phrases, the labels of phrases and of everything, and a score from 0 to 1.

    The score is the largest share of a notice that stands in the file; PHRASE_SCORE where only a phrase
    does; 0 where nothing does.
    """
    label = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    of_phrases = F.filter("matches", lambda m: m["phrase"])
    of_notices = F.transform(F.filter("matches", lambda m: ~m["phrase"]), lambda m: m["share"])
    starts = F.transform(of_phrases, lambda m: m["start"])
    score = F.coalesce(F.array_max(of_notices), F.when(F.size("matches") > 0, F.lit(PHRASE_SCORE)), F.lit(0.0))
    return scan(docs, templates).select(
        "doc_id",
        "n_words",
        F.size(of_phrases).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label(of_phrases).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        F.least(F.lit(1.0), score).alias("score"),
    )
