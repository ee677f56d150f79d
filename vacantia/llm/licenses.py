"""Licence scans with a generalised suffix automaton over the words of licence templates.

One automaton holds all substrings of all templates. A text's words stream through it and give, for each place, the longest run
of words ending there that occurs in some template (its matching statistics). Runs that cannot be extended and are long enough
become anchors in their templates; anchors that keep their order are chained into spans, and a span's covered share
of the template decides whether its label counts. Short base phrases are templates too: the automaton's suffix links tell
where one ends, so every place is counted.

Words are runs of ASCII letters and digits and of all non-ASCII characters, after lower-casing A-Z.

Defined results: a null or wordless text has no words, no places, empty labels and score 0; repeated rows give repeated
results; extra columns are ignored; an empty table gives no rows. A text is one stream, whatever its length; memory is
one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacantia.llm.common import binary_column, text_slices

# Base phrases, and opening passages and notices of public licences.
BASE_PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
            "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
               "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and "
            "the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Words of the shortest run that anchors a span (shorter templates need all their words), words that may lie between two
#: anchors of a span, and the covered share of a template from which its label counts.
MIN_RUN, MAX_GAP, MIN_COVERED = 4, 20, 0.6
#: What a base phrase alone scores.
PHRASE_SCORE = 0.5

_SEPARATE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATE).split()


@dataclass(frozen=True)
class Span:
    """Words ``first`` to ``last`` of a text cover this share of a template."""

    label: str
    first: int
    last: int
    covered: float


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Where the strings of a state end: (sequence, last word).
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.number.setdefault(word, len(self.number)))
                self.ends[last].add((k, at))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of ``q`` that extend ``p`` by ``c``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match ending there) for each place with a match."""
        state = length = 0
        following, link, lengths = self.next, self.link, self.length
        for place, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = length = 0
                continue
            while state and c not in following[state]:
                state = link[state]
                length = lengths[state]
            if c in following[state]:
                state = following[state][c]
                length += 1
                yield place, state, length


class Scanner:
    """The automaton of templates and phrases, and what to do with its matches."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.templates = [(label, words_of(text.encode())) for label, text in templates]
        self.phrases = [(label, words_of(text.encode())) for label, text in phrases]
        self.automaton = Automaton([w for _, w in self.templates] + [w for _, w in self.phrases])
        a, first = self.automaton, len(self.templates)
        self.shortest = min(MIN_RUN, min(len(w) for _, w in self.templates))
        #: Per state, the phrases that its strings end with; a state that ends a phrase itself may hold shorter strings too.
        self.phrase_ends: list[list[int]] = [[] for _ in a.link]
        for k, (_, words) in enumerate(self.phrases):
            state = 0
            for word in words:
                state = a.next[state][a.number[word]]
            self.phrase_ends[state].append(k)
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.phrase_ends[state] = self.phrase_ends[a.link[state]] + self.phrase_ends[state]
        self.anchors = [[(k, end) for k, end in sorted(ends) if k < first] for ends in a.ends]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """Number of words, base places as (phrase, first word), and spans of templates."""
        words = words_of(text)
        places: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        before: tuple[int, int, int] | None = None
        for place, state, length in self.automaton.stream(words):
            for k in self.phrase_ends[state]:
                size = len(self.phrases[k][1])
                if length >= size:
                    places.append((k, place - size + 1))
            # A run ends where the next match does not extend it.
            if before and before[2] >= self.shortest and not (place == before[0] + 1 and length == before[2] + 1):
                runs.append(before)
            before = (place, state, length)
        if before and before[2] >= self.shortest:
            runs.append(before)
        return len(words), places, self._chain(runs)

    def _chain(self, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Spans from runs in text order: an anchor joins the open span of its template that it extends in order, within the
        gap, with the most words covered; else it opens a span."""
        open_spans: dict[int, list[list[int]]] = {}
        closed: list[Span] = []
        for place, state, length in runs:
            for k, end in self.anchors[state]:
                size = len(self.templates[k][1])
                if length < min(MIN_RUN, size):
                    continue
                first, begin = place - length + 1, end - length + 1
                held = open_spans.setdefault(k, [])
                for span in [s for s in held if first - s[1] > MAX_GAP]:
                    held.remove(span)
                    closed += self._closed(k, span)
                fitting = [s for s in held if s[2] < end and s[1] < place]
                if fitting:
                    span = max(fitting, key=lambda s: s[3])
                    # Words shared with the anchor before count once.
                    new = min(length, end - max(span[2], begin - 1), place - max(span[1], first - 1))
                    held.append([span[0], place, end, span[3] + new])
                else:
                    held.append([first, place, end, length])
        for k, held in open_spans.items():
            for span in held:
                closed += self._closed(k, span)
        best: dict[tuple[str, int], Span] = {}
        for span in closed:
            key = span.label, span.first
            if key not in best or (span.covered, span.last) > (best[key].covered, best[key].last):
                best[key] = span
        return sorted(best.values(), key=lambda s: (s.first, s.last, s.label))

    def _closed(self, k: int, span: list[int]) -> list[Span]:
        label, words = self.templates[k]
        covered = span[3] / len(words)
        return [Span(label, span[0], span[1], min(1.0, covered))] if covered >= MIN_COVERED else []


SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, covered: double>>")
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]


def scan_documents(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """``SCAN`` per row of ``docs`` (doc_id, text). The texts pass through one Arrow job and are not shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        names = [c.split()[0] for c in SCAN.split(", ")[:8]] + ["spans"]
        for batch in batches:
            texts = binary_column(batch, "text")
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            for start, end in text_slices(texts):
                rows = [_row(scanner, t) for t in texts[start:end]]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, end - start), *columns], names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCAN)


def _row(scanner: Scanner, text: bytes) -> tuple:
    n, places, spans = scanner.scan(text)
    base = {scanner.phrases[k][0] for k, _ in places}
    starts = [s for _, s in places]
    score = max([PHRASE_SCORE if base else 0.0, *[s.covered for s in spans]])
    return (
        n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {s.label for s in spans})), score, [s.__dict__ for s in spans])
