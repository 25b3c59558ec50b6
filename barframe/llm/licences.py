"""Licence scans with a generalised suffix automaton of licence words.

The word sequences of all templates go into one suffix automaton. A text's words are streamed through it; at
each word the automaton knows the longest run of words ending there that occurs in some template (the matching
statistics). A run that grows no further is a match if it has ``LEAST`` words. Matches that follow each other
both in the text and in one template, with at most ``GAP`` other words between, are chained; the share of the
template's words that its best chain covers is the template's score in that text.

Base phrases are templates too: a phrase stands where the automaton has read all of it.

Defined results: a null or empty text has no words, no places and score 0; repeated rows are scanned alike;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import map_arrow

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening sentences, conditions and disclaimers of public licence notices, and their labels.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("public-domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
)
#: Words of a match, other words within a chain, and the covered share from which a template labels a text.
LEAST, GAP, SHARE = 3, 8, 0.6
#: Of a table of whole licence texts, paragraphs of so many words are templates; it may hold so many bytes.
PARAGRAPH, TABLE_BYTES = 10, 32 << 20
#: Other bytes than 0-9, a-z and those above 127 part words; A-Z are folded.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NONE = "\0"
_RUN = re.compile("[^\0]{2,}")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Automaton:
    """The suffix automaton of several word sequences. Words are characters here, so that runs of them are strings."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        sequences = [words_of(t) for t, _ in phrases] + [words_of(t) for _, t in templates]
        self.n_phrases = len(phrases)
        self.letters: dict[bytes, str] = {}
        for s in sequences:
            for w in s:
                self.letters.setdefault(w, chr(len(self.letters) + 1))
        self.templates = ["".join(self.letters[w] for w in s) for s in sequences]
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for t in self.templates:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self._places()

    def _extend(self, last: int, c: str) -> int:
        if c in self.next[last]:  # an earlier template goes this way already
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, moves: dict[str, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _places(self) -> None:
        """Where in which templates each state's words end, and which phrases are their ends."""
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        whole = defaultdict(list)
        for t, sequence in enumerate(self.templates):
            state = 0
            for place, c in enumerate(sequence):
                state = self.next[state][c]
                up = state
                while up > 0:
                    self.ends[up].append((t, place))
                    up = self.link[up]
            if t < self.n_phrases:
                whole[state].append((t, len(sequence)))
        for state in range(len(self.next)):
            up = state
            while up > 0:
                self.phrases[state] += whole.get(up, [])
                up = self.link[up]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(phrase, first word) of every place of a base phrase, and the matches as (first word, words, state)."""
        look_up = self.letters.get
        text = "".join([look_up(w, _NONE) for w in words])
        found, matches = [], []
        for run in _RUN.finditer(text):
            state = length = 0
            for i in range(run.start(), run.end() + 1):
                c = text[i] if i < run.end() else _NONE
                before, had = state, length
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state, length = self.next[state][c], length + 1
                else:
                    state = length = 0
                if length <= had and had >= LEAST:
                    matches.append((i - had, had, before))
                for phrase, size in self.phrases[state]:
                    if size <= length:
                        found.append((phrase, i - size + 1))
        return found, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, float, int, int]]:
        """(template, covered share, first word, end) of the best chain of each template that matches touch."""
        by_template = defaultdict(list)
        for first, size, state in matches:
            for t, end in self.ends[state]:
                by_template[t].append((first, size, end - size + 1))
        out = []
        for t, pieces in by_template.items():
            pieces.sort()
            chains: list[tuple[int, int]] = []  # words covered by the best chain that ends with each piece, and where it begins
            near = 0
            for k, (first, size, place) in enumerate(pieces):
                while pieces[near][0] + len(self.templates[t]) + GAP < first:
                    near += 1
                best = (size, first)
                for m in range(near, k):
                    f, s, q = pieces[m]
                    over = max(0, f + s - first, q + s - place)
                    if q < place and f < first and over < size and first - (f + s) <= GAP and place - (q + s) <= GAP:
                        best = max(best, (chains[m][0] + size - over, chains[m][1]))
                chains.append(best)
            k = max(range(len(chains)), key=lambda k: (chains[k][0], -pieces[k][0]))
            out.append((t, min(1.0, chains[k][0] / len(self.templates[t])), chains[k][1], pieces[k][0] + pieces[k][1]))
        return out


def findings(automaton: Automaton, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    found, matches = automaton.scan(words)
    places = [at for _, at in found]
    base = {automaton.labels[p] for p, _ in found}
    spans = automaton.spans(matches)
    covered = {automaton.labels[t] for t, share, _, _ in spans if share >= SHARE}
    score = max([share for _, share, _, _ in spans] + [1.0] * bool(found), default=0.0)
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | covered)), score


def templates_of(licences: DataFrame) -> tuple[tuple[str, str], ...]:
    """The paragraphs of a table (label, text) of whole licence texts, for ``scan_licences``; its size is checked."""
    size = licences.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > TABLE_BYTES:
        raise ValueError(f"{size} bytes of licence texts, more than {TABLE_BYTES}")
    rows = licences.where("label is not null and text is not null").select("label", "text").distinct().orderBy("label", "text").collect()
    return tuple(dict.fromkeys((r["label"], p) for r in rows for p in re.split(r"\n\s*\n", r["text"]) if len(words_of(p)) >= PARAGRAPH))


def scan_licences(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row. One pass."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        automaton = Automaton(templates=templates)
        for batch in batches:
            if batch.num_rows:
                rows = zip(*[findings(automaton, t) for t in batch.column("text").to_pylist()], strict=True)
                yield pa.record_batch([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def covered_spans(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, label, template, share, first_word, end_word): the best chain of every template that a text touches."""

    def run(batches):
        automaton = Automaton(templates=templates)
        for batch in batches:
            out = [(d, automaton.labels[t], t, share, first, end) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                   for t, share, first, end in automaton.spans(automaton.scan(words_of(text))[1])]
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["doc_id", "label", "template", "share", "first_word", "end_word"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, label string, template long, share double, first_word long, end_word long")
