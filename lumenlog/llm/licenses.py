"""Licence scan: a generalised suffix automaton of licence tokens and chained long matches.

The automaton holds every licence template. A document's words are streamed through it once, which
gives the matching statistics: at each word the length of the longest run ending there that occurs
in some template. Long right-maximal runs are chained per template into covered spans; a template
covered far enough gives its label. The base phrases are templates too: a phrase stands at a place
exactly if its state is the current state or one of its suffix-link ancestors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import documents, map_rows, raw_texts

#: Words of lower-cased UTF-8: digits, a-z and everything outside ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Well-known licence notices and openings of licence texts, by label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Released under the MIT License",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "licensed under the GNU General Public License, version 2",
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This work is licensed under the GNU General Public License, version 3",
        "licensed under the GNU General Public License, version 3",
    ),
    "lgpl": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "agpl-3": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ),
}

#: A run shorter than this many words (or than the template) is not chained.
LEAST_RUN = 3
#: Words that may lie between two chained runs.
MOST_GAP = 8
#: The covered share of a template from which its label is given.
LEAST_COVER = 0.9


def words_of(data: bytes) -> list[bytes]:
    return WORD.findall(data.lower())


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: template -> the last position of the state's runs in it
    ends: dict[int, int] = field(default_factory=dict)
    #: phrases (index, length) whose runs end wherever this state's do
    phrases: tuple[tuple[int, int], ...] = ()


class Automaton:
    """A generalised suffix automaton over the words of several templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        self.states = [State()]
        self.vocabulary: dict[bytes, int] = {}
        self.labels, self.lengths = [], []
        self.phrase_labels, self.phrase_lengths = list(phrases.values()), []
        rows = [(label, self._ids(text)) for label, several in templates.items() for text in several]
        phrase_rows = [self._ids(text) for text in phrases]
        for _, row in [*rows, *((None, p) for p in phrase_rows)]:
            last = 0
            for token in row:
                last = self._extend(last, token)
        for i, (label, row) in enumerate(rows):
            self.labels.append(label)
            self.lengths.append(len(row))
            at = 0
            for j, token in enumerate(row):
                at = self.states[at].next[token]
                up = at
                while up > 0 and i not in self.states[up].ends:
                    self.states[up].ends[i] = j
                    up = self.states[up].link
        own: dict[int, list[tuple[int, int]]] = {}
        for i, row in enumerate(phrase_rows):
            self.phrase_lengths.append(len(row))
            at = 0
            for token in row:
                at = self.states[at].next[token]
            own.setdefault(at, []).append((i, len(row)))
        for k, state in enumerate(self.states):
            found, up = [], k
            while up > 0:
                found += own.get(up, [])
                up = self.states[up].link
            state.phrases = tuple(found)

    def _ids(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        if token in states[last].next:
            q = states[last].next[token]
            return q if states[q].length == states[last].length + 1 else self._split(last, token, q)
        states.append(State(states[last].length + 1))
        new, p = len(states) - 1, last
        while p >= 0 and token not in states[p].next:
            states[p].next[token] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].next[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._split(p, token, q)
        return new

    def _split(self, p: int, token: int, q: int) -> int:
        states = self.states
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        clone = states[q].link = len(states) - 1
        while p >= 0 and states[p].next.get(token) == q:
            states[p].next[token] = clone
            p = states[p].link
        return clone

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(start, phrase) of every base place and (first word, words, state) of every right-maximal run."""
        vocabulary, states = self.vocabulary, self.states
        places, runs = [], []
        state = length = 0
        before = -2
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != before + 1 and length:
                runs.append((before - length + 1, length, state))
                state = length = 0
            token = vocabulary[words[i]]
            if token not in states[state].next:
                if length:
                    runs.append((before - length + 1, length, state))
                while state and token not in states[state].next:
                    state = states[state].link
                    length = states[state].length
            state = states[state].next.get(token, 0)
            length = length + 1 if state else 0
            for phrase, n in states[state].phrases:
                if n <= length:
                    places.append((i - n + 1, phrase))
            before = i
        if length:
            runs.append((before - length + 1, length, state))
        return places, runs

    def covered(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, covered share) of the best chain of each template with a share of LEAST_COVER or more, and the best share of all."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, state in runs:
            if n >= LEAST_RUN:
                for template, end in self.states[state].ends.items():
                    by_template.setdefault(template, []).append((start, n, end - n + 1))
        found = []
        for template, own in by_template.items():
            length = self.lengths[template]
            for first, end, share in self._chains(own, length):
                found.append((self.labels[template], first, end, share))
        return found

    @staticmethod
    def _chains(own: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, float]]:
        """Chains runs in document order whose places in the template also go up, with short gaps in both."""
        chains: list[list[int]] = []  # first word, end word, end in the template, covered words
        for start, n, at in sorted(own):
            last = chains[-1] if chains else None
            if last and 0 <= start - last[1] <= MOST_GAP and 0 <= at - last[2] <= MOST_GAP:
                last[1], last[2], last[3] = start + n, at + n, last[3] + n
            elif last and start < last[1] and at > last[2] - n and at + n > last[2] and at - start == last[2] - last[1]:
                grown = start + n - last[1]
                last[1], last[2], last[3] = start + n, at + n, last[3] + grown
            else:
                chains.append([start, start + n, at + n, n])
        return [(a, b, min(1.0, covered / length)) for a, b, _, covered in chains]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(TEMPLATES, PHRASES)


def scan(data: bytes) -> dict:
    """What the operator reports of one text."""
    machine = automaton()
    words = words_of(data)
    places, runs = machine.stream(words)
    chains = machine.covered(runs)
    full = [c for c in chains if c[3] >= LEAST_COVER]
    base = sorted({machine.phrase_labels[p] for _, p in places})
    starts = [a for a, _ in places]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": base, "labels": sorted({*base, *(c[0] for c in full)}),
        "score": 1.0 if base else max((c[3] for c in chains), default=0.0),
        "found": [{"label": k, "first_word": a, "end_word": b, "share": s} for k, a, b, s in sorted(set(full), key=lambda c: (c[1], c[0]))],
    }


SCHEMA = StructType(
    [StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")), *(StructField(n, ArrayType(StringType())) for n in ("base_labels", "labels")), StructField("score", DoubleType())]
    + [StructField("found", ArrayType(StructType([StructField("label", StringType()), StructField("first_word", LongType()), StructField("end_word", LongType()), StructField("share", DoubleType())])))]
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: word count, base places and labels, all labels, score, and covered template spans.

    A narrow step over whole texts in which the automaton is the only state. Null and empty texts
    have no words: counts 0, places null, no labels, score 0. Repeated rows each get their result.
    """

    def per_chunk(batch: pa.RecordBatch) -> dict:
        rows = [scan(t) for t in raw_texts(batch)]
        return {"doc_id": batch.column("doc_id")} | {n: [r[n] for r in rows] for n in SCHEMA.names[1:]}

    return map_rows(documents(docs), SCHEMA, per_chunk)


def license_digest(docs: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")
