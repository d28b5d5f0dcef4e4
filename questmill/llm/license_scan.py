"""Scan of documents for licence texts with a generalised suffix automaton.

The words of all templates and phrases make one suffix automaton, of a size that
depends on them alone; every task gets it. A document's words stream through it and
give its matching statistics: for every word, the longest run of words that ends
there and occurs in some template, and the state of that run, which knows where in
the templates it ends. Whether a phrase ends at a word is read off the state.

Of each template the runs that cannot go on are kept and chained: in order in
document and template, with at most MAX_GAP words of the document between two. A
chain that covers enough of its template is a span, so wrapped, renamed and lightly
edited texts are found too. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questmill.llm.common import in_slices, terms_of

#: Licence notices as they are published, by name: the label and the words. Fixed values.
TEMPLATES = {
    "mit": (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "mit-line": ("mit", "Released under the MIT License"),
    "apache-2.0": (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "apache-line": ("apache", "Licensed under the Apache License, Version 2.0"),
    "gpl": (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "gpl-line": ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    "lgpl": (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
    ),
    "mpl-2.0": (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    "bsd": (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "isc": (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    "unlicense": ("unlicense", "This is free and unencumbered software released into the public domain"),
    "cc-by": ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-line": ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    "reserved": ("all-rights-reserved", "All rights reserved"),
}
#: Phrases of the contract with their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words of a run that counts (or the whole template, where that is shorter), words between two runs of a chain, share of a template that is a span.
LEAST_RUN, MAX_GAP, COVERED = 4, 40, 0.5

SCHEMA = (
    "doc_id long, n_words long, places array<struct<label: string, first: long, last: long>>, "
    "spans array<struct<label: string, template: string, first: long, last: long, words: int, coverage: double>>, coverage double"
)


def words_of(text: str) -> list[str]:
    """The words of one text."""
    return terms_of(pa.array([text]))[0].to_pylist()


class Automaton:
    """Suffix automaton of several lists of words. State 0 is the empty run."""

    def __init__(self, texts: list[list[str]]):
        self.number: dict[str, int] = {}
        self.texts = [[self.number.setdefault(w, len(self.number)) for w in t] for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [[]]
        for k, text in enumerate(self.texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word, ends)
                ends[last].append((k, at))
        # A state's run ends wherever those that it is a suffix of end.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] += ends[state] if self.link[state] else []
        self.ends = ends
        width = len(self.number)
        self.pairs = np.zeros((width + 1) * (width + 1), bool)
        for t in self.texts:
            for a, b in zip(t[:-1], t[1:], strict=True):
                self.pairs[a * (width + 1) + b] = True

    def _state(self, length: int, ends: list[list]) -> int:
        self.next.append({}), self.link.append(0), self.length.append(length), ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, ends: list[list]) -> int:
        """The state of p's longest run and word, made from the state that word leads to, if that holds longer runs."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, ends)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list[list]) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        new, p = self._state(self.length[last] + 1, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, word, ends)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For every word, the length of the longest run that ends there, and its state."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(w)) is not None:
                state, length = to, length + 1
            else:
                state = length = 0
            yield length, state

    def runs(self, length: int, state: int, least: int) -> Iterator[tuple[int, int, int]]:
        """Text, last word and length of all runs of least words or more that end where a run of this length and state does."""
        seen: set[tuple[int, int]] = set()
        while state and length >= least:
            for k, at in self.ends[state]:
                if (k, at) not in seen:
                    seen.add((k, at))
                    yield k, at, length
            state = self.link[state]
            length = self.length[state]


def chain(runs: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """Chains of runs (last word in the document, last word in the template, words), each as words covered, first and last word in the document.

    Runs are in order of the document. A run belongs to one chain at most; chains that cover more come first.
    """
    best, before = [], []
    for j, (d, t, n) in enumerate(runs):
        most, of = n, -1
        for i in range(j - 1, -1, -1):
            e, u, _ = runs[i]
            if d - n - e > max_gap:
                break
            gain = min(n, t - u, d - e)
            if gain > 0 and t - n >= u - runs[i][2] and best[i] + gain > most:
                most, of = best[i] + gain, i
        best.append(most), before.append(of)
    used, out = [False] * len(runs), []
    for j in sorted(range(len(runs)), key=lambda j: (-best[j], j)):
        if used[j]:
            continue
        k, lost = j, 0
        while True:
            used[k] = True
            if before[k] < 0:
                break
            if used[before[k]]:  # the rest is part of a better chain
                lost = best[before[k]]
                break
            k = before[k]
        out.append((best[j] - lost, runs[k][0] - runs[k][2] + 1, runs[j][0]))
    return out


class Scanner:
    """Templates (name: label and text) and phrases (text: label) over one automaton."""

    def __init__(self, templates: Mapping[str, tuple[str, str]], phrases: Mapping[str, str]):
        self.names = list(templates)
        self.labels = [label for label, _ in templates.values()] + list(phrases.values())
        texts = [words_of(text) for _, text in templates.values()] + [words_of(p) for p in phrases]
        if any(len(t) < 2 for t in texts):
            raise ValueError("a template or phrase needs two words at least")
        self.automaton = Automaton(texts)
        self.sizes = [len(t) for t in texts]
        self.least = min([LEAST_RUN, *self.sizes])
        self.vocabulary = pa.array(list(self.automaton.number), pa.string())

    def scan(self, words: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[list[tuple], list[tuple], float]:
        """Places of phrases, spans, and the greatest share of a template that is covered, from a document's word numbers and the stretches of pairs that templates hold."""
        auto, n = self.automaton, len(self.names)
        places, runs = [], {}
        for a, b in stretches:
            stretch = words[a:b].tolist()
            for i, (length, state) in enumerate(auto.statistics(stretch)):
                follows = stretch[i + 1] if i + 1 < len(stretch) else -1
                for k, at, size in auto.runs(length, state, 2):
                    text = auto.texts[k]
                    if k >= n:
                        if at == len(text) - 1 and size >= len(text):
                            places.append((self.labels[k], a + i - len(text) + 1, a + i))
                    elif size >= min(self.least, len(text)) and (at + 1 == len(text) or text[at + 1] != follows) and size >= min(LEAST_RUN, len(text)):
                        runs.setdefault(k, []).append((a + i, at, size))
        spans, covered = [], 1.0 if places else 0.0
        for k, found in runs.items():
            for size, first, last in chain(found, MAX_GAP):
                share = size / self.sizes[k]
                covered = max(covered, share)
                if share >= COVERED:
                    spans.append((self.labels[k], self.names[k], first, last, size, share))
        return sorted(places, key=lambda p: (p[1], p[2])), sorted(spans, key=lambda s: (s[2], s[3], s[1])), covered


def _rows(batches: Iterator[pa.RecordBatch], scanner: Scanner) -> Iterator[pa.RecordBatch]:
    width = len(scanner.vocabulary)
    for batch in in_slices(batches, 64):
        flat, sizes = terms_of(batch.column(1))
        words = pc.fill_null(pc.index_in(flat, scanner.vocabulary), width).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        pair = scanner.automaton.pairs[words[:-1] * (width + 1) + words[1:]] if len(words) else np.empty(0, bool)
        pair[starts[(starts > 0) & (starts < len(words))] - 1] = False  # a document's last word and the next one's first
        edge = np.flatnonzero(np.diff(np.concatenate([[False], pair, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2] + 1
        of = np.searchsorted(starts, begin, side="right") - 1
        out = []
        for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True)):
            a, b = np.searchsorted(of, i), np.searchsorted(of, i, side="right")
            found = scanner.scan(words[starts[i] : starts[i] + n], list(zip((begin[a:b] - starts[i]).tolist(), (end[a:b] - starts[i]).tolist(), strict=True))) if a < b else ([], [], 0.0)
            places = [dict(zip(("label", "first", "last"), p, strict=True)) for p in found[0]]
            spans = [dict(zip(("label", "template", "first", "last", "words", "coverage"), s, strict=True)) for s in found[1]]
            out.append({"doc_id": doc, "n_words": n, "places": places, "spans": spans, "coverage": found[2]})
        yield pa.RecordBatch.from_pylist(out, ARROW)


_PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.int32()), ("coverage", pa.float64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(_PLACE)), ("spans", pa.list_(_SPAN)), ("coverage", pa.float64())])


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, tuple[str, str]], phrases: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_words, places, spans, coverage.

    places are all occurrences of a phrase (label, first and last word from 0), spans
    the parts that cover COVERED or more of a template (with its label and name, the
    words covered and their share), coverage the greatest share, also below that, and
    1 where a phrase stands. A null text is empty and has none. Null ids and repeated
    rows are scanned like others; other columns are ignored.
    """
    scanner = Scanner(templates, phrases)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _rows(b, scanner), SCHEMA).withColumnRenamed("doc_id", id_col)
