"""Benchmark leaks: short test items inside long documents, by size-partitioned MinHash containment search.

A document leaks an item if it holds ``PERCENT`` of the item's five-word shingles. Jaccard similarity hides
that when the document is long, so the search is partitioned by size on both sides. A document is sketched
by one-permutation MinHash: its shingle hashes fall into bins, the least of each bin is kept. How many bins
that takes follows from both sizes: an item whose class has k shingles to share is missed with (1 - p) ** k,
p being the chance that a shared shingle is the least of its bin, so p is set to make that ``MISS``, and the
bins to give p at the document's size. Large items need few bins, small ones many, tiny ones all shingles.
An item and a document with an equal register are a candidate; candidates are settled by exact containment.

Items of one text are searched as one, and the matches meet the ids of all of them. The distinct texts go
through in blocks of about ``BLOCK_BYTES``, each block broadcast; documents are never shuffled. Items shorter than five words are one shingle of their own length and are looked up in full.

Defined results: null, empty and wordless texts or items match nothing; repeated rows match alike; rows
without id are matched with a null id; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import BASE_2, U64, Words, chunks, map_arrow, mixed, windows
from barframe.llm.neardup import SHINGLE, shingle_sets

PERCENT = 80
MISS = 1e-7
BLOCK_BYTES = 32 << 20
#: Lower ends of the item classes, in shingles.
CLASSES = (1, 8, 16, 32, 64, 128, 512)


def _load(least_shared: int) -> float:
    """Shingles a bin at which ``least_shared`` shared ones are all hidden with probability MISS; 0: keep all."""
    need = 1 - MISS ** (1 / least_shared)
    if need > 0.93:
        return 0.0
    low, high = 1e-6, 64.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - math.exp(-mid)) / mid > need else (low, mid)
    return low


class Index:
    """The items of one block: exact shingle sets, and their registers for every number of bins that is asked for."""

    def __init__(self, items: list[tuple[int | str, str]], percent: int = PERCENT):
        self.percent = percent
        column = pa.array([t for _, t in items], pa.string())
        sets, lengths = shingle_sets(column), Words(column).per_document
        use = [i for i, s in enumerate(sets) if len(s)]
        self.ids = [items[i][0] for i in use]
        self.sets = [sets[i] for i in use]
        lengths = lengths[use]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({int(n) for n in lengths if n < SHINGLE}):
            at = np.flatnonzero(lengths == k)
            self.short[k] = self._sorted([(self.sets[i][:1], i) for i in at])
        sizes = np.array([len(s) for s in self.sets])
        of = np.searchsorted(CLASSES, sizes, side="right") - 1 if len(sizes) else np.empty(0, int)
        self.classes = [(np.flatnonzero((of == c) & (lengths >= SHINGLE)), _load(-(-percent * CLASSES[c] // 100))) for c in sorted(set(of.tolist()))]
        self.classes = [(members, load) for members, load in self.classes if len(members)]
        self.cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _sorted(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        values, owners = np.concatenate([v for v, _ in parts]), np.concatenate([np.full(len(v), i) for v, i in parts])
        order = np.argsort(values, kind="stable")
        return values[order], owners[order]

    def registers(self, c: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted registers of the items of a class with 2**bits bins, and whose each is."""
        if (c, bits) not in self.cache:
            self.cache[c, bits] = self._sorted([(self.sets[i][least_of_bins(self.sets[i], bits)], i) for i in self.classes[c][0]])
        return self.cache[c, bits]

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(document number, item number, shared shingles) of a chunk of texts."""
        words = Words(column)
        hashes = words.hashes(lower=True)
        found, _, docs = windows(hashes, words.first, SHINGLE)
        out = []
        if len(found):
            ends = np.cumsum(np.bincount(docs, minlength=len(words.per_document)))
            sets = [np.unique(found[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            sizes = np.array([len(s) for s in sets])
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            candidates = set()
            for c, (_, load) in enumerate(self.classes):
                bits = np.full(len(sets), 64) if load == 0 else np.minimum(64, np.ceil(np.log2(np.maximum(sizes, 1) / load)).clip(1)).astype(int)
                for b in np.unique(bits[sizes > 0]):
                    part = np.flatnonzero(bits[owner] == b)
                    values, of = every[part], owner[part]
                    if b < 64:
                        cell = values >> U64(64 - b)
                        first = np.ones(len(part), bool)
                        first[1:] = (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])
                        values, of = values[first], of[first]
                    candidates |= set(self._equal(values, of, *self.registers(c, int(b))))
            for d, i in sorted(candidates):
                shared = int(np.isin(self.sets[i], sets[d], assume_unique=True).sum())
                if 100 * shared >= self.percent * len(self.sets[i]):
                    out.append((d, i, shared))
        for k, (values, of) in self.short.items():
            found, _, docs = windows(hashes, words.first, k, BASE_2)
            out += [(d, i, 1) for d, i in sorted(set(self._equal(mixed(found + U64(k)), docs, values, of)))]
        return out

    @staticmethod
    def _equal(values: np.ndarray, owner: np.ndarray, known: np.ndarray, of: np.ndarray):
        """(owner, item) of equal registers; an item register may belong to several items."""
        left, right = np.searchsorted(known, values, "left"), np.searchsorted(known, values, "right")
        for k in np.flatnonzero(right > left):
            for i in of[left[k] : right[k]]:
                yield int(owner[k]), int(i)


def least_of_bins(values: np.ndarray, bits: int) -> np.ndarray:
    """Which of the sorted ``values`` are the least of their bin, bins being the leading bits."""
    if bits >= 64:
        return np.ones(len(values), bool)
    cell = values >> U64(64 - bits)
    first = np.ones(len(values), bool)
    first[1:] = cell[1:] != cell[:-1]
    return first


@lru_cache(maxsize=4)
def _index(shared, percent: int) -> Index:
    return Index(shared.value, percent)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """(hash, text) of the distinct texts of the items, in blocks of bounded text; one pass a block, so the driver holds one block's worth at a time."""
    texts = benchmark.select("text").where("text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select(F.md5("text").alias("mark"), "text").orderBy("mark").collect()
        if rows:
            yield [(r["mark"], r["text"]) for r in rows]


def find_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) of every leak."""
    schema = "doc_id long, mark string, item_shingles long, shared_shingles long"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    spark, parts = documents.sparkSession, []
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            index = _index(shared, percent)
            for batch in chunks(batches):
                if found := index.matches(batch.column("text")):
                    ids = batch.column("doc_id").to_pylist()
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*[(ids[d], index.ids[i], len(index.sets[i]), n) for d, i, n in found], strict=True), kinds, strict=True)],
                                          names=["doc_id", "mark", "item_shingles", "shared_shingles"])

        parts.append(map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), search, schema))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, item_shingles long, shared_shingles long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    items = benchmark.where("text is not null").select(F.md5("text").alias("mark"), F.col("item_id").cast("long").alias("item_id"))
    return out.join(items, "mark").select("doc_id", "item_id", "item_shingles", "shared_shingles")


def without_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that leak no item; all columns as they are."""
    spark, left = documents.sparkSession, documents
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            index = _index(shared, percent)
            for batch in chunks(batches):
                hit = {d for d, _, _ in index.matches(batch.column(batch.schema.get_field_index("text")))}
                yield batch.filter(pa.array([d not in hit for d in range(batch.num_rows)]))

        left = map_arrow(left, keep, documents.schema)
    return left
