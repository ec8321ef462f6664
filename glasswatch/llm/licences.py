"""Licence scans by a generalised suffix automaton of template words.

The automaton holds every run of words of every template.  A text is streamed through it word by word; after each word the
state tells the longest run ending there that some template has (its matching statistic) and where templates have it.  Runs of LEAST
words or more that the next word does not lengthen are matches.  Matches that follow each other in the text and in one template, at most
GAP words apart in the text, are chained; words that two of them share count once.  A chain covers a span of the text and a share of its template.

A pair of words that no template has next to each other ends every match of two words or more, so only stretches of known pairs go
through the automaton; all other words cost one look-up.  A label is added where a chain covers COVER of a template.

The base phrases are plain places of consecutive words, found whatever the automaton says.

Everything is per text: no shuffle, no group.  Null and empty texts have no words, no places and score 0; repeated rows and null ids
are kept as they are.  A chain takes the leftmost template place that goes on from its end, else the first; matches that fit no open chain open a new one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.llm.common import query, small, table

LEAST, GAP, COVER = 3, 12, 0.6
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LONG = 1 << 20

# Phrases whose every place counts, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices of public licences, and the lines by which files name them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: bytes):
    """Lower-cased words of a UTF-8 text, A-Z alone being lowered; those of a long text one by one."""
    text = text.lower()
    return _WORD.findall(text) if len(text) < _LONG else (m[0] for m in _WORD.finditer(text))


class Automaton:
    """Every run of words of the templates: states with transitions by word number, suffix links and end places."""

    def __init__(self, templates, phrases=()):
        self.labels, self.sizes, self.first = [], [], []
        self.number: dict[bytes, int] = {}
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [[]]
        pairs, place = set(), 0
        for label, text in templates:
            ids = self._ids(text)
            self.labels.append(label)
            self.sizes.append(len(ids))
            self.first.append(place)
            pairs.update(zip(ids, ids[1:]))
            state = 0
            for w in ids:
                state = self._extended(state, w)
                self.ends[state].append(place)
                place += 1
        self.phrases = [(self._ids(text), label) for text, label in phrases]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[state] = sorted(set(self.ends[state]))
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.pairs = np.array(sorted(a * len(self.number) + b for a, b in pairs), np.int64)

    def _ids(self, text: str) -> list[int]:
        return [self.number.setdefault(w, len(self.number)) for w in words(text.encode())]

    def _state(self, length: int, next_: dict, link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, state: int, w: int, to: int) -> int:
        """The state of the runs ending with w that are one longer than the state's: ``to`` itself or a clone of it."""
        if self.length[to] == self.length[state] + 1:
            return to
        clone = self._state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = clone
        while state >= 0 and self.next[state].get(w) == to:
            self.next[state][w] = clone
            state = self.link[state]
        return clone

    def _extended(self, last: int, w: int) -> int:
        if w in self.next[last]:  # another template has this run already
            return self._split(last, w, self.next[last][w])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, w, self.next[last][w])
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state, and the length of the longest run ending there that a template has."""
        state, run = 0, 0
        for w in ids:
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
            yield state, run

    def matches(self, ids: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the runs of ``least`` words or more that the next word does not lengthen."""
        state, run = 0, 0
        for at, (new, longer) in enumerate(self.statistics(ids)):
            if run >= least and longer != run + 1:
                yield at, run, state
            state, run = new, longer
        if run >= least:
            yield len(ids), run, state

    def stretches(self, ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """Start and end of the runs of words whose every pair some template has; shorter than ``least`` ones hold no match."""
        a, b = ids[:-1], ids[1:]
        near = np.flatnonzero((a >= 0) & (b >= 0))
        code = a[near].astype(np.int64) * len(self.number) + b[near]
        known = near[self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code] if len(self.pairs) else near[:0]
        if len(known):
            cut = np.flatnonzero(np.diff(known) > 1)
            for s, e in zip(known[np.r_[0, cut + 1]].tolist(), (known[np.r_[cut, len(known) - 1]] + 2).tolist()):
                if e - s >= least:
                    yield s, e


def chained(automaton: Automaton, matches, gap: int) -> list[tuple[str, int, int, int, float]]:
    """From (start, length, state) in text order: (label, first word, word after the last, words covered, share) of each chain."""
    open_: dict[int, list[int]] = {}  # template: first, end in the text, end in the template, covered
    done = []

    def close(t):
        first, end, _, covered = open_.pop(t)
        done.append((automaton.labels[t], first, end, covered, covered / automaton.sizes[t]))

    for start, n, state in matches:
        places: dict[int, list[int]] = {}
        for end in automaton.ends[state]:
            t = bisect_right(automaton.first, end) - 1
            places.setdefault(t, []).append(end - automaton.first[t] + 1 - n)
        for t, begins in places.items():
            if t in open_:
                chain = open_[t]
                # What the chain has already, in the text or in the template, is cut off the match's front.
                fits = ((max(0, chain[1] - start, chain[2] - b), b) for b in begins)
                cut, at = next(((c, b) for c, b in fits if c < n and start - chain[1] <= gap), (None, None))
                if cut is not None:
                    chain[1], chain[2], chain[3] = start + n, at + n, chain[3] + n - cut
                    continue
                if start < chain[1]:  # lies within what the chain has
                    continue
                close(t)
            open_[t] = [start, start + n, begins[0] + n, n]
    for t in list(open_):
        close(t)
    return sorted(done, key=lambda x: (x[1], x[2], x[0], x[3]))


_SPANS = "array<struct<label:string,first:long,end:long,covered:long,share:double>>"
_PLACES = "array<struct<label:string,word:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, least: int = LEAST,
         gap: int = GAP) -> DataFrame:
    """One row per document: id, n_words, places (label and first word of every phrase) and spans (chains of template matches)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases)
        get, gap_mark = automaton.number.get, np.array([-1], np.int32)
        types = (pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])),
                 pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])))
        for batch in small(batches, 1):
            parts = []
            for text in batch.column(1).cast(pa.large_binary()):
                parts += [np.fromiter(map(get, words(text.as_py() or b""), repeat(-1)), np.int32), gap_mark]
            sizes = np.array([len(p) for p in parts[::2]], np.int64)
            ids = np.concatenate(parts) if parts else gap_mark[:0]
            begin = np.cumsum(sizes + 1) - sizes - 1
            places, found = [[] for _ in sizes], [[] for _ in sizes]
            for phrase, label in automaton.phrases:
                here = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
                for k, w in enumerate(phrase):
                    here &= ids[k:k + len(here)] == w
                at = np.flatnonzero(here)
                for doc, word in zip((np.searchsorted(begin, at, "right") - 1).tolist(), at.tolist()):
                    places[doc].append({"label": label, "word": word - int(begin[doc])})
            for s, e in automaton.stretches(ids, least):
                doc = int(np.searchsorted(begin, s, "right")) - 1
                base = s - int(begin[doc])
                found[doc] += [(base + end - n, n, state) for end, n, state in automaton.matches(ids[s:e].tolist(), least)]
            spans = [[dict(zip(("label", "first", "end", "covered", "share"), x)) for x in chained(automaton, m, gap)] if m else [] for m in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(places, types[0]), pa.array(spans, types[1])],
                                             ["id", "n_words", "places", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(find, f"id {id_type}, n_words long, places {_PLACES}, spans {_SPANS}").withColumnRenamed("id", id_col)


@query("op12_licence_scan")
def op12(spark, sf):
    """Licence phrases and covered templates of every document; no SQL twin (chains over an automaton's matches)."""
    found = scan(table(spark, sf, "documents"))
    named = F.filter("spans", lambda x: x["share"] >= COVER)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", F.transform(named, lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max("spans.share"), F.lit(0.0)).alias("score"))
