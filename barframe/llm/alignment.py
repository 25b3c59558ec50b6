"""Alignment of two tokenizers by sparse incidence matrices.

A document's tokens of either kind cover the same bytes. The incidence of tokens and bytes is a sparse matrix A (or
B); its row product A·Bᵀ links the tokens that overlap, with the number of bytes they share. Where tokens of both
kinds end, the text falls into groups; the incidence of token ids and groups, with the counts as values, multiplied
likewise gives every pair of ids that share a group and how often. Matrices are in compressed rows, built by hand
for a chunk of documents at a time, and multiplied row by row in slices of bounded size.

Corpus-wide counts need each document's distinct pairs only: they are written once, with how often each is linked,
summed up by pair, and met again by an equi-join: a broadcast one if the counted table has few rows, else a shuffled
one, whose hot pairs adaptive execution splits (the counts are one row a pair).

Both tokenizers work on words, cut where both of them must begin a token; words are encoded once by the libraries
and remembered in two bounded generations.

Defined results: a text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens,
zeros and an empty digest. Repeated rows, rows of one id and rows without id each are documents of their own. An
empty table gives an empty result. Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.bpe import LATIN, byte_letters
from barframe.llm.common import chunks, map_arrow
from barframe.session import cut

#: A single space between visible characters begins a token in both tokenizers.
_SEAM = re.compile(r"(?<=[^ ]) (?=\S)")
STOPS = ".,;:!?"
#: Such a word is one pre-token.
only_letters = re.compile(f"[{LATIN}]+").fullmatch
#: Words in one generation of what a worker remembers, none longer than WORD_CHARS.
REMEMBERED, WORD_CHARS = 200_000, 40
#: Products of a matrix that are held at once.
PRODUCTS = 1 << 22
#: The table of pair counts is broadcast up to so many rows (about 50 MB).
BROADCAST_ROWS = 1 << 20


class Csr:
    """A sparse matrix in compressed rows: row i has ``columns[starts[i]:starts[i + 1]]`` and the values beside them."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def of_counts(cls, rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        """How often each (row, column) is given."""
        cells, counts = np.unique(rows * width + columns, return_counts=True)
        return cls(np.searchsorted(cells, np.arange(height + 1) * width), cells % width, counts, width)

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Rows that cover the columns one after the other."""
        n = int(lengths.sum())
        return cls(np.concatenate(([0], np.cumsum(lengths))), np.arange(n), np.ones(n, np.int64), n)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Csr(starts, rows[order], self.values[order], self.height)

    def times(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of the product, rows in order: a row is the sum of the other's rows that its entries name.

        Slices of whole rows with about ``PRODUCTS`` terms; a row with more is a slice of its own.
        """
        if not len(self.columns):
            return
        lengths = np.diff(other.starts)[self.columns]
        terms = np.concatenate(([0], np.cumsum(lengths)))[self.starts]
        a = 0
        while a < self.height:
            b = max(a + 1, int(np.searchsorted(terms, terms[a] + PRODUCTS, side="right")) - 1)
            part = slice(self.starts[a], self.starts[b])
            n = lengths[part]
            before = np.cumsum(n) - n
            at = np.repeat(other.starts[self.columns[part]] - before, n) + np.arange(int(n.sum()))
            row = np.repeat(np.repeat(np.arange(a, b), np.diff(self.starts[a : b + 1])), n)
            cell = row * other.width + other.columns[at]
            value = np.repeat(self.values[part], n) * other.values[at]
            if len(cell):
                if (cell[1:] < cell[:-1]).any():
                    order = np.argsort(cell, kind="stable")
                    cell, value = cell[order], value[order]
                first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                yield cell[first] // other.width, cell[first] % other.width, np.add.reduceat(value, first)
            a = b


class Side:
    """One tokenizer: ids of words, and the bytes of its tokens."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode, self.size = encode, len(tokens)
        self.width = np.array([len(t) for t in tokens])
        self.begin = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        # If no token holds a letter and then a stop, stops behind a word are tokens of their own.
        self.stops: dict[str, bytes] = {}
        parted = not any(re.search(f"[{LATIN}][{STOPS}]", t.decode("utf-8", "replace")) for t in tokens)
        self.stopped = re.compile(f"([{LATIN}]+)([{STOPS}]{{1,3}})").fullmatch if parted else lambda word: None

    def _stop(self, stops: str) -> bytes:
        if stops not in self.stops:
            letter, both = self.encode(["a", "a" + stops])
            self.stops[stops] = array("i", both[len(letter) :]).tobytes()
        return self.stops[stops]

    def learn(self, words: set[str]) -> None:
        """Enter the words that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        known, old, stopped = self.known, self.old, self.stopped
        new, ended = [], []
        for word in words.difference(known):
            if word in old:
                known[word] = old[word]
            elif m := stopped(word):
                ended.append((word, *m.groups()))
            else:
                new.append(word)
        new.extend({base for _, base, _ in ended}.difference(known, words))
        for word, ids in zip(new, self.encode(new) if new else [], strict=True):
            known[word] = array("i", ids).tobytes()
            if len(word) > WORD_CHARS:
                self.long.append(word)
        for word, base, stops in ended:
            known[word] = known[base] + self._stop(stops)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. A text is a list of known words."""
        parts = [b"".join(map(self.known.__getitem__, words)) for words in texts]
        return np.frombuffer(b"".join(parts), np.int32).astype(np.int64), np.array([len(p) // 4 for p in parts])

    def forget(self) -> None:
        """Drop the words of the last text that are too long to keep."""
        for word in self.long:
            del self.known[word]
        self.long = []

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.width[ids]
        return self.bytes[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def byte_level(path: str) -> Side:
    """Words behind a space by a byte-level tokenizer file; strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    if library.normalizer is not None:
        raise ValueError(f"{path}: texts are changed before they are encoded")
    byte = byte_letters()
    letter = {b: c for c, b in byte.items()}
    latin = {ord(c): "".join(letter[b] for b in c.encode()) for c in LATIN}
    tokens = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
    spelt = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
    # The library's steps one by one, which spares it all but the ids.
    parts, model, space = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize, letter[0x20]

    def encode(words: list[str]) -> list[list[int]]:
        out = []
        for word in words:
            if only_letters(word):
                out.append([t.id for t in model(space + word.translate(latin))])
            else:
                out.append([t.id for part, _ in parts(" " + word) for t in model(part)])
        return out

    return Side(encode, spelt)


def pieces(path: str) -> Side:
    """Words by a piece model, which puts a space before each itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in library.id_to_piece(i).lstrip("▁") for i in range(library.get_piece_size())):
        raise ValueError(f"{path}: pieces that cross words")
    spelt = [bytes([int(library.id_to_piece(i)[3:-1], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
             for i in range(library.get_piece_size())]
    return Side(lambda words: library.encode(words, num_threads=1), spelt)


def _true(texts: list[str], side: Side, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts, a space before each, are given back by the ids."""
    wanted = [(" " + t).encode() for t in texts]
    sizes = np.array([len(w) for w in wanted], np.int64)
    text_of = np.repeat(np.arange(len(texts)), counts)
    good = np.bincount(text_of, weights=side.width[ids], minlength=len(texts)).astype(np.int64) == sizes
    given = side.joined(ids[good[text_of]])
    same = given == np.frombuffer(b"".join(w for w, g in zip(wanted, good, strict=True) if g), np.uint8)
    good[np.repeat(np.flatnonzero(good), sizes[good])[~same]] = False
    return good


class Aligned:
    """The alignment of a chunk of texts; arrays run over the texts that have tokens (``whole``)."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        words = [_SEAM.split(t) if t else [] for t in texts]
        distinct = set().union(*words)
        (ids_a, n_a), (ids_b, n_b) = (self._encoded(side, words, distinct) for side in (a, b))
        self.whole = np.array([bool(t) for t in texts], bool)
        for side, ids, n in ((a, ids_a, n_a), (b, ids_b, n_b)):
            self.whole[self.whole] = _true([t for t, w in zip(texts, self.whole, strict=True) if w], side, ids[np.repeat(self.whole, n)], n[self.whole])
        self.a, self.b = a, b
        self.ids_a, self.ids_b = ids_a[np.repeat(self.whole, n_a)], ids_b[np.repeat(self.whole, n_b)]
        self.n_a, self.n_b = n_a[self.whole], n_b[self.whole]
        ends_a, ends_b = np.cumsum(a.width[self.ids_a]), np.cumsum(b.width[self.ids_b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.n = len(ends)
        self.group_a, self.group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        self.text_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.text_of = self.text_a[np.searchsorted(self.group_a, np.arange(self.n))] if self.n else np.empty(0, np.int64)

    @staticmethod
    def _encoded(side: Side, words: list[list[str]], distinct: set[str]) -> tuple[np.ndarray, np.ndarray]:
        side.learn(distinct)
        out = side.ids(words)
        side.forget()
        return out

    def per_text(self, of_group: np.ndarray) -> np.ndarray:
        return np.bincount(self.text_of, weights=of_group, minlength=len(self.n_a)).astype(np.int64)

    def links_per_text(self) -> np.ndarray:
        in_a, in_b = (np.bincount(g, minlength=self.n) for g in (self.group_a, self.group_b))
        return self.per_text(in_a * in_b)

    def overlaps_per_text(self) -> np.ndarray:
        """Number of token pairs that share bytes: entries of A·Bᵀ."""
        out = np.zeros(len(self.n_a), np.int64)
        for row, _, _ in Csr.of_lengths(self.a.width[self.ids_a]).times(Csr.of_lengths(self.b.width[self.ids_b]).transposed()):
            out += np.bincount(self.text_a[row], minlength=len(out))
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, id of a, id of b, times linked), distinct, in order."""
        named, row = np.unique(self.text_a * self.a.size + self.ids_a, return_inverse=True)
        by_id = Csr.of_counts(row, self.group_a, len(named), self.n)
        by_group = Csr.of_counts(self.group_b, self.ids_b, self.n, self.b.size)
        found = [(named[r], c, v) for r, c, v in by_id.times(by_group)]
        which, id_b, times = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        return which // self.a.size, which % self.a.size, id_b, times

    def groups(self, spelt: list[bytes]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text; ``spelt`` as ``spellings`` has it."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (self.group_a, self.group_b))
        before_b = np.searchsorted(self.group_b, self.group_a)
        upto_a = np.searchsorted(self.group_a, self.group_b, side="right")
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        codes[np.arange(len(self.ids_a)) + before_b] = 2 * self.ids_a + last_a
        codes[np.arange(len(self.ids_b)) + upto_a] = 2 * (self.a.size + self.ids_b) + last_b
        bounds, items = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist(), codes.tolist()
        return [b"".join(map(spelt.__getitem__, items[x:y]))[:-1] for x, y in zip(bounds, bounds[1:], strict=False)]


def spellings(a: Side, b: Side) -> list[bytes]:
    """For twice an id (b's ids behind a's): the id and a comma; one more: the id and what ends its side of a group."""
    return [x for side, end in ((a, b"|"), (b, b";")) for i in range(side.size) for x in (b"%d," % i, b"%d%s" % (i, end))]


_WORKER: dict[tuple[str, str], tuple[Side, Side, list[bytes]]] = {}


def _worker(byte_tokenizer: str, piece_model: str) -> tuple[Side, Side, list[bytes]]:
    key = (byte_tokenizer, piece_model)
    if key not in _WORKER:
        a, b = byte_level(byte_tokenizer), pieces(piece_model)
        _WORKER[key] = (a, b, spellings(a, b))
    return _WORKER[key]


_LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<long>"


def links(documents: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """A row a document: counts, digest of its groups, and its distinct linked pairs (a * 2^32 + b) with how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, spelt = _worker(byte_tokenizer, piece_model)
        for batch in chunks(batches):
            x = Aligned([t or "" for t in batch.column("text").to_pylist()], a, b)
            text, id_a, id_b, times = x.pairs()
            sizes = np.zeros(batch.num_rows, np.int64)
            sizes[x.whole] = np.bincount(text, minlength=len(x.n_a))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            digests = np.full(batch.num_rows, "", object)
            digests[x.whole] = [hashlib.sha256(g).hexdigest() for g in x.groups(spelt)]

            def column(values: np.ndarray, x: Aligned = x, n: int = batch.num_rows) -> pa.Array:
                out = np.zeros(n, np.int64)
                out[x.whole] = values
                return pa.array(out)

            yield pa.record_batch(
                [batch.column("doc_id"), column(x.n_a), column(x.n_b), column(x.per_text(np.ones(x.n))), column(x.links_per_text()), column(x.overlaps_per_text()),
                 pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(id_a << 32 | id_b)), pa.ListArray.from_arrays(offsets, pa.array(times))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "times"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _LINKS)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, count, best) of every pair in ``linked``: how many documents hold it, and whether no pair of its a-id has more."""
    counts = cut(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "alignment-counts")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return cut(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "alignment-pairs")


def align(documents: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """Per document its counts, how many of its links are the corpus-wide likeliest for their a-id, and the sum of their counts."""
    linked = cut(links(documents, byte_tokenizer, piece_model).withColumn("row", F.monotonically_increasing_id()), "alignment-links")
    counts = pair_counts(linked)
    few = counts.count() <= BROADCAST_ROWS
    each = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = each.join(F.broadcast(counts) if few else counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return linked.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256", "n_overlaps")
