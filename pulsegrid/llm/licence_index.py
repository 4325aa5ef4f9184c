"""Licence scan by a positional rare-token index.

Templates are indexed as postings word -> (template, position). The document frequency of
every licence word over the whole corpus gives its IDF. A file's licence words are looked up
from the highest IDF down: a base phrase is found by intersecting the positions of its words,
each shifted by its place in the phrase; a longer template by votes of its rarest words for
one offset, and then by its mandatory key phrases near that offset.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import parts, texts, utf8

# Phrases and labels that are always reported.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Openings and telling sentences of public licences, and identifiers (label, text,
# mandatory key phrases).
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("hereby granted free", "person obtaining", "associated documentation"),
    ),
    ("apache", "licensed under the apache license version 2 0", ("apache license version",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        ("free software", "gnu general public license"),
    ),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("binary forms", "without modification", "permitted provided"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("copy modify", "without fee", "hereby granted"),
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed", "cc", "nc")),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("attribution sharealike",)),
    (
        "cc0",
        "the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        ("associated cc0",),
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("merchantability", "noninfringement"),
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache org licenses",),
    ),
    (
        "gpl-2",
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "version 2"),
    ),
    (
        "gpl-3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "version 3"),
    ),
    (
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    (
        "agpl",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution",
        ("accompanying materials", "eclipse public license"),
    ),
    (
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("prior written permission",),
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ("accompanying documentation covered",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ("held liable",),
    ),
    (
        "artistic",
        "you may copy distribute and modify this package under the terms of the artistic license",
        ("artistic license",),
    ),
    *((label, f"spdx license identifier {tag}", (f"spdx license identifier {tag}",)) for tag, label in (
        ("mit", "mit"), ("apache 2 0", "apache"), ("gpl 2 0", "gpl-2"), ("gpl 3 0", "gpl-3"), ("lgpl", "lgpl"), ("agpl 3 0", "agpl"),
        ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd-3"), ("mpl 2 0", "mpl"), ("epl 2 0", "epl"), ("isc", "isc"), ("zlib", "zlib"), ("bsl 1 0", "boost"), ("cc0 1 0", "cc0"),
    )),
)

# Every byte that is no digit, lower-case letter or part of a non-ASCII character becomes a space.
_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)
ASKED = 5
SLACK = 2
SHARE = 0.6


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in order, in lists of bounded length."""
    for part in parts(utf8(text).translate(_LOWER)):
        yield part.split()


def _template_words() -> list[bytes]:
    lines = [phrase for phrase, _ in BASE] + [text for _, text, _ in TEMPLATES]
    return sorted({w for line in lines for w in line.encode().split()})


def _frequencies(batches: Iterator[pa.RecordBatch], words: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    found, rows = Counter(), 0
    for batch in batches:
        for text in texts(batch):
            rows += 1
            present: set[bytes] = set()
            for own in word_parts(text):
                present |= words.intersection(own)
            found.update(present)
    names = [b"", *found]
    yield pa.RecordBatch.from_arrays(
        [pa.array([n.decode() for n in names]), pa.array([rows, *found.values()], pa.int64())], names=["word", "docs"]
    )


def licence_idf(docs: DataFrame) -> dict[bytes, float]:
    """IDF of every template word over all rows of ``docs``; one bounded row per word."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_frequencies, words=frozenset(_template_words())), "word string, docs long"
    )
    found = {r["word"].encode(): r["docs"] for r in counted.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}
    rows = found.pop(b"", 0) or 0
    return {w: math.log((1 + rows) / (1 + found.get(w, 0))) for w in _template_words()}


class PositionalIndex:
    """Template postings, and the scan of one file against them."""

    def __init__(self, idf: dict[bytes, float], common: float = math.log(4)):
        self.idf = idf
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE]
        self.templates = [
            (label, text.encode().split(), [tuple(k.encode().split()) for k in keys]) for label, text, keys in TEMPLATES
        ]
        #: The words of each template's key phrases, all of which a file must have.
        self.required = [frozenset(w for k in keys for w in k) for _, _, keys in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        needed = {w for words, _ in self.base for w in words} | {w for _, _, keys in self.templates for k in keys for w in k}
        for n, (_, words, _) in enumerate(self.templates):
            for at, word in enumerate(words):
                # Words in over a quarter of all files say little; they are kept only where
                # a phrase needs them.
                if word in needed or idf[word] >= common:
                    self.postings[word].append((n, at))
        self.words = frozenset(needed) | frozenset(self.postings)

    def positions(self, text: str | None) -> tuple[int, dict[bytes, list[int]]]:
        at, found = 0, defaultdict(list)
        words = self.words
        for own in word_parts(text):
            if not words.isdisjoint(own):
                for n, word in enumerate(own, at):
                    if word in words:
                        found[word].append(n)
            at += len(own)
        return at, found

    def places(self, phrase: tuple[bytes, ...], found: dict[bytes, list[int]]) -> list[int]:
        """Where a phrase stands: its words' positions, shifted and intersected, rarest first."""
        order = sorted(range(len(phrase)), key=lambda i: (-self.idf[phrase[i]], i))
        starts: set[int] | None = None
        for i in order:
            own = found.get(phrase[i])
            if not own:
                return []
            if starts is None:
                starts = {p - i for p in own if p >= i}
            else:
                starts.intersection_update([p - i for p in own])
            if not starts:
                return []
        return sorted(starts or ())

    def template_share(self, n: int, found: dict[bytes, list[int]], asked: list[bytes]) -> float:
        """The share of a template's indexed words that stand in relative position, where
        its rarest words agree on an offset and all key phrases stand near it; else 0."""
        _, words, keys = self.templates[n]
        votes: Counter[int] = Counter()
        for word in asked:
            for template, at in self.postings[word]:
                if template == n:
                    votes.update(p - at for p in found[word])
        need = min(2, len({w for w in asked if any(t == n for t, _ in self.postings[w])}))
        best = 0.0
        phrase_places = None
        for offset in votes:
            if sum(votes.get(offset + d, 0) for d in range(-SLACK, SLACK + 1)) < max(1, need):
                continue
            if phrase_places is None:
                phrase_places = [self.places(k, found) for k in keys]
            if not all(_any_in(p, offset - SLACK, offset + len(words) + SLACK) for p in phrase_places):
                continue
            indexed = [(w, i) for i, w in enumerate(words) if (n, i) in self.postings.get(w, ())]
            there = sum(_any_in(found.get(w, ()), offset + i - SLACK, offset + i + SLACK) for w, i in indexed)
            best = max(best, there / len(indexed))
        return best if best >= SHARE else 0.0

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        n_words, found = self.positions(text)
        if not found:
            return n_words, 0, None, None, "", "", 0.0
        base, starts, score = set(), [], 0.0
        for phrase, label in self.base:
            if places := self.places(phrase, found):
                base.add(label)
                starts += places
        labels = set(base)
        asked = sorted((w for w in found if w in self.postings), key=lambda w: (-self.idf[w], w))
        rarest: dict[int, list[bytes]] = defaultdict(list)
        for word in asked:
            for n in {template for template, _ in self.postings[word]}:
                if len(rarest[n]) < ASKED:
                    rarest[n].append(word)
        for n, own in rarest.items():
            if self.required[n] <= found.keys() and (share := self.template_share(n, found, own)):
                labels.add(self.templates[n][0])
                score = max(score, share)
        return (
            n_words, len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else score,
        )


def _any_in(places: list[int], low: int, high: int) -> bool:
    at = bisect_left(places, low)
    return at < len(places) and places[at] <= high


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def _scanned(batches: Iterator[pa.RecordBatch], index: PositionalIndex) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = [index.scan(t) for t in texts(batch)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)


def licence_scan(docs: DataFrame) -> DataFrame:
    """Licence labels of every row of ``docs``, from its whole text.

    Null and empty texts have no words, no labels (empty strings) and score 0. A base phrase
    gives score 1, else the score is the share of a template's words found in place. Rows
    with a null or repeated doc_id are scanned like others; an empty table gives no rows;
    other columns are not read.
    """
    index = PositionalIndex(licence_idf(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scanned, index=index), SCHEMA)
