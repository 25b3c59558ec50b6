"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one or two measures. On a bounded sample every rule is timed and its
rejections counted; the cascade then runs the rules by rejections a second, and each rule reads only the
documents that all rules before it let pass. The order decides what the work costs, never the verdict: a
document is kept if no rule rejects it.

Defined results: a null or empty text has no words and all measures 0; repeated rows are judged alike; an
empty table gives an empty result and the order in which the rules are written; columns other than id and
text are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import U64, Words, chunks, map_arrow, mixed, windows

SAMPLE_ROWS = 1000
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_SHOUT = np.isin(np.arange(256), [33])


class Measures:
    """Measures of a chunk of texts, each worked out when a rule first asks for it."""

    def __init__(self, column: pa.Array):
        self.column = column

    @cached_property
    def words(self) -> Words:
        return Words(self.column)

    def _per_document(self, marked: np.ndarray) -> np.ndarray:
        running = np.concatenate(([0], np.cumsum(marked)))
        return running[self.words.bounds[1:]] - running[self.words.bounds[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.per_document

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points within words: bytes of words that don't continue a character."""
        from barframe.llm.common import GAP

        data = self.words.data
        return self._per_document(~GAP[data] & ((data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_document(SYMBOLS[self.words.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._per_document(_UPPER[self.words.data])

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._per_document(_LOWER[self.words.data])

    @cached_property
    def n_shouts(self) -> np.ndarray:
        return self._per_document(_SHOUT[self.words.data])

    @cached_property
    def lines(self) -> np.ndarray:
        """Lines with a word, and those of them that equal an earlier one."""
        out = np.zeros((len(self.column), 2), np.int64)
        for i, text in enumerate(self.column.to_pylist()):
            if text:
                full = [x for x in text.encode().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                out[i] = len(full), len(full) - len(set(full))
        return out

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[:, 1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words under three-word windows that the text holds at least twice."""
        found, at, docs = windows(self.words.hashes(), self.words.first, 3)
        edges = np.zeros(len(self.words.starts) + 1, np.int64)
        if len(found):
            own = mixed(found + mixed(docs.astype(U64)))
            order = np.argsort(own)
            same = own[order][1:] == own[order][:-1]
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            np.add.at(edges, at[twice], 1)
            np.add.at(edges, at[twice] + 3, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
        return covered[self.words.first[1:]] - covered[self.words.first[:-1]]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


#: Fixed limits in whole numbers, so that every engine agrees on them.
BASE = [
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
]
METHOD = [
    Rule("symbols", lambda m: 100 * m.n_symbols > 8 * m.word_chars),
    Rule("capitals", lambda m: 100 * m.n_upper > 60 * (m.n_upper + m.n_lower)),
    Rule("shouts", lambda m: 100 * m.n_shouts > 30 * m.n_words),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
    Rule("dup_lines", lambda m: 100 * m.n_dup_lines > 60 * m.lines[:, 0]),
]


def order_rules(documents: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules by rejections a second, each with its seconds a document and the share that it rejects.

    Measured on the ``rows`` documents that come first by a hash of their id.
    """
    ids = documents.select("doc_id").where("doc_id is not null").withColumn("_order", F.md5(F.col("doc_id").cast("string"))).orderBy("_order", "doc_id").limit(rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("text")
    names = [r.name for r in rules]

    def measure(batches):
        seconds, rejected, n = np.zeros(len(rules)), np.zeros(len(rules)), 0
        for batch in chunks(batches):
            n += batch.num_rows
            for k, rule in enumerate(rules):
                start = time.perf_counter()
                rejected[k] += int(rule.rejects(Measures(batch.column("text"))).sum())
                seconds[k] += time.perf_counter() - start
        if n:
            yield pa.record_batch([pa.array(names), pa.array(seconds), pa.array(rejected), pa.array([float(n)] * len(rules))], names=["name", "seconds", "rejected", "n"])

    found = map_arrow(sample, measure, "name string, seconds double, rejected double, n double").groupBy("name").agg(
        F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    known = {r["name"]: (r["seconds"] / r["n"], r["rejected"] / r["n"]) for r in found}
    rated = [(r, *known.get(r.name, (1.0, 0.0))) for r in rules]
    return sorted(rated, key=lambda x: -x[2] / max(x[1], 1e-12))


def cascade(column: pa.Array, rules: list[Rule], alive: np.ndarray | None = None) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 if none does; texts not ``alive`` are not looked at (-2)."""
    verdict = np.full(len(column), -2)
    at = np.arange(len(column)) if alive is None else np.flatnonzero(alive)
    verdict[at] = -1
    measures = Measures(column if len(at) == len(column) else column.take(pa.array(at)))
    for k, rule in enumerate(rules):
        if not len(at):
            break
        out = rule.rejects(measures)
        if out.any():
            verdict[at[out]] = k
            at = at[~out]
            measures = Measures(column.take(pa.array(at)))
    return verdict


def judged(documents: DataFrame, base: list[Rule] = BASE, method: list[Rule] = METHOD) -> DataFrame:
    """(doc_id, the five measures, base_failed, kept) of every row. One pass; the sample decides the order of ``method``."""
    ordered = [r for r, _, _ in order_rules(documents, method)]

    def run(batches):
        for batch in chunks(batches):
            column = batch.column("text")
            m = Measures(column)
            failed = np.any([r.rejects(m) for r in base], axis=0)
            kept = cascade(column, ordered, ~failed) == -1
            counts = [pa.array(x.astype(np.int64)) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
            yield pa.record_batch([batch.column("doc_id"), *counts, pa.array(failed), pa.array(kept)],
                                  names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
