"""Collocations by marginalising the longest windows.

At every word a window of ``ORDER`` words begins, padded with nulls where its piece ends. Only these windows are
counted: a phrase of k words stands as often as the windows that begin with it, so the counts of shorter phrases
are the sums of ROLLUP over ever shorter prefixes, and no n-gram is ever exploded on its own.

Most windows are rare, and a phrase below ``least`` is no candidate, nor part of one. So a window ends early at a
pair of words that is rare (by a filter that knows every frequent pair), and before the ROLLUP it is cut back to its
longest prefix that stands often enough. Windows are dealt by their first two words, hence a task knows these sums by
itself; pairs that hold very many windows are dealt by their third word, too, and keep both words. Windows are added
up within blocks of text before they are shuffled.

Defined results: a null or empty text has no words; a null language is ``und``; equal documents count each; an empty
table gives no rows; only ``text`` and ``lang`` are read, whatever other columns there are. Ties in the order go by
count, then by the phrase's bytes. A very long text is worked through in blocks that end with a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm import bloom
from barframe.llm.common import BASE_1, U64, Words, map_arrow, mixed, signed, text_bytes
from barframe.session import cut

ORDER = 4
LEAST = 30
TOP = 2000
#: Scores are SCALE * a / (l + r), rounded down.
SCALE = 2_000_000
#: A candidate goes if a longer one around it has at least this share of its count (percent).
COVERED = 80
#: What ends a piece, and what lies between words.
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = STOPS.copy()
BREAKS[[0x20, 0x09]] = True
#: Bytes of text whose windows are added up at once.
BLOCK_BYTES = 8 << 20
OUT_ROWS = 1 << 16
#: Distinct pairs that a task gathers before it passes them on.
HELD_PAIRS = 4_000_000
#: A pair of words with more than this share of a sample's windows is dealt by its third word, too.
HOT_SHARE, SAMPLE_OF, SALTS = 1 / 2000, 64, 32
WORDS = [f"w{k + 1}" for k in range(ORDER)]
_SCHEMA = f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, languages) of about ``BLOCK_BYTES``; a longer text comes in parts that end with a piece."""
    held: list[tuple[bytes, str]] = []
    size = 0

    def block() -> tuple[pa.Array, pa.Array]:
        return pa.array([t for t, _ in held], pa.binary()), pa.array([x for _, x in held], pa.string())

    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang"), strict=True):
            rest, lang = text.as_py() or b"", lang.as_py()
            while rest:
                part, rest = rest, b""
                if len(part) > BLOCK_BYTES:
                    stops = np.flatnonzero(STOPS[np.frombuffer(part, np.uint8)[BLOCK_BYTES:]])
                    if len(stops):
                        part, rest = part[: BLOCK_BYTES + int(stops[0])], part[BLOCK_BYTES + int(stops[0]) :]
                held.append((part, lang))
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
    if held:
        yield block()


class Block:
    """The words of a block as numbers, where windows may run, and the languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, _ = text_bytes(texts)
        words = Words(texts, BREAKS)
        self.size = n = len(words.starts)
        letters = data[~BREAKS[data]]
        letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
        offsets = np.concatenate(([0], np.cumsum(words.ends - words.starts))).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.words, self.numbers = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # A piece is named by the stops before it and its text.
        text = np.repeat(np.arange(len(texts)), words.per_document)
        self.piece = np.cumsum(STOPS[data])[words.starts] + text if n else text
        tongue = langs.dictionary_encode()
        self.langs, self.spoken = tongue.dictionary, tongue.indices.to_numpy()[text].astype(np.int64)

    def lead(self, column: np.ndarray, k: int) -> np.ndarray:
        """The value k words further on, -1 beyond the piece."""
        out = np.full(self.size, -1)
        if self.size > k:
            out[:-k] = np.where(self.piece[k:] == self.piece[:-k], column[k:], -1)
        return out

    def pairs(self) -> np.ndarray:
        """A hash of language, word and next word at every word; 0 at the last word of a piece."""
        after = self.lead(self.numbers, 1)
        word, tongue = (np.array([xxhash.xxh64_intdigest(x) for x in column.to_pylist()], U64) for column in (self.words, self.langs))
        if not self.size:
            return np.empty(0, U64)
        return np.where(after < 0, U64(0), mixed(word[self.numbers] * BASE_1 + word[after] + tongue[self.spoken]) | U64(1))

    def windows(self, frequent: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct windows in order: columns of word numbers (-1: none), languages and counts.

        A window ends where its piece ends, or before the first pair of words that ``frequent`` does not know.
        """
        columns, goes_on = [self.numbers], np.ones(self.size, bool)
        known = np.ones(self.size, bool) if frequent is None else bloom.holds(frequent, self.pairs())
        for k in range(1, ORDER):
            goes_on = goes_on & (self.lead(known.astype(np.int64), k - 1) == 1 if k > 1 else known)
            columns.append(np.where(goes_on, self.lead(self.numbers, k), -1))
        front, back = columns[0] << 32 | columns[1] & 0xFFFFFFFF, (columns[2] & 0xFFFFFFFF) << 32 | columns[3] & 0xFFFFFFFF
        by = np.lexsort((back, front, self.spoken))
        new = np.ones(self.size, bool)
        new[1:] = (np.diff(front[by]) != 0) | (np.diff(back[by]) != 0) | (np.diff(self.spoken[by]) != 0)
        at = np.flatnonzero(new)
        return [c[by[at]] for c in columns], self.spoken[by[at]], np.diff(np.append(at, self.size))


def _distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values = values[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.add.reduceat(counts[order], at)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        found, counts = _distinct(*map(np.concatenate, zip(*held, strict=True)))
        for a in range(0, len(found), OUT_ROWS):
            yield pa.record_batch([signed(found[a : a + OUT_ROWS]), pa.array(counts[a : a + OUT_ROWS])], names=["pair", "n"])

    for texts, langs in _blocks(batches):
        pairs = Block(texts, langs).pairs()
        pairs = pairs[pairs != 0]
        if len(pairs):
            held.append(_distinct(pairs, np.ones(len(pairs), np.int64)))
        if sum(len(p) for p, _ in held) > HELD_PAIRS:
            yield from out()
            held = []
    if held:
        yield from out()


def frequent_pairs(documents: DataFrame, least: int = LEAST) -> np.ndarray:
    """A filter of the pairs of words that stand ``least`` times, by hashes: equal hashes only make it larger."""
    texts = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = map_arrow(texts, _pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return bloom.made_of(cut(counted.where(F.col("n") >= least).select("pair"), "collocation-pairs"))


def _windows(frequent: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _blocks(batches):
            block = Block(texts, langs)
            columns, spoken, counts = block.windows(None if frequent is None else frequent.value)
            words = block.words.cast(pa.large_string()).cast(pa.string())
            for a in range(0, len(counts), OUT_ROWS):
                part = slice(a, a + OUT_ROWS)
                taken = [words.take(pa.array(c[part], mask=c[part] < 0)) for c in columns]
                yield pa.record_batch([block.langs.take(pa.array(spoken[part])), *taken, pa.array(counts[part])], names=["lang", *WORDS, "n"])

    return run


def windows(documents: DataFrame, frequent: Broadcast | None = None) -> DataFrame:
    """(lang, w1..w4, n): padded windows with their counts, added up within blocks of text only."""
    return map_arrow(documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang")), _windows(frequent), _SCHEMA)


def hot_pairs(documents: DataFrame, frequent: Broadcast) -> list[str]:
    """``w1 w2 lang`` of the pairs that hold a large share of the windows, by a sample of the texts; at most 1 / ``HOT_SHARE`` of them.

    They only decide which task counts a window, never a result.
    """
    sample = windows(documents.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_OF)) == 0), frequent)
    pairs = cut(sample.groupBy("lang", "w1", "w2").agg(F.count(F.lit(1)).alias("rows")), "collocation-sample")
    total = pairs.agg(F.sum("rows").alias("s")).first()["s"] or 0
    return [r["pair"] for r in pairs.where((F.col("rows") > HOT_SHARE * total) & F.col("w2").isNotNull()).select(F.concat_ws(" ", "w1", "w2", "lang").alias("pair")).collect()]


def frequent_prefixes(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, w1..w4, n): windows added up, each cut back to its longest prefix of ``least`` occurrences (or to one word)."""
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_pairs(documents, least))
    hot = hot_pairs(documents, frequent)
    salt = F.when(F.concat_ws(" ", "w1", "w2", "lang").isin(hot), F.pmod(F.xxhash64("w3"), F.lit(SALTS)).cast("int")).otherwise(-1) if hot else F.lit(-1)
    dealt = windows(documents, frequent).withColumn("salt", salt).repartition("lang", "w1", "w2", "salt")
    counted = dealt.groupBy("lang", "w1", "w2", "salt", "w3", "w4").agg(F.sum("n").alias("n"))
    three, two = Window.partitionBy("lang", "w1", "w2", "salt", "w3"), Window.partitionBy("lang", "w1", "w2", "salt")
    summed = counted.withColumn("n3", F.sum("n").over(three)).withColumn("n2", F.sum("n").over(two))
    fit4 = F.col("n") >= least
    fit3 = fit4 | (F.col("n3") >= least)
    fit2 = fit3 | (F.col("n2") >= least) | (F.col("salt") >= 0)
    short = summed.select("lang", "w1", *[F.when(fit, F.col(w)).alias(w) for w, fit in zip(WORDS[1:], (fit2, fit3, fit4), strict=True)], "n")
    return cut(short.groupBy("lang", *WORDS).agg(F.sum("n").alias("n")), "collocation-windows")


def phrase_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of 1 to 4 words with ``least`` occurrences, (lang, n) of all words)."""
    sums = frequent_prefixes(documents, least).rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Level: one bit a column that is summed over. A null that is not summed over is padding: no phrase of that length.
    filled = [F.col(WORDS[k - 1]).isNotNull() & (F.col("level") == 2 ** (ORDER - k) - 1) for k in range(1, ORDER + 1)]
    whole = F.col("level") == 2**ORDER - 1
    some = filled[0] | filled[1] | filled[2] | filled[3]
    kept = cut(sums.where(whole | (some & (F.col("f") >= least))).select(
        "lang", F.when(~whole, F.array_compact(F.array(*WORDS))).alias("words"), "f"), "collocation-phrases")
    phrases = kept.where("words is not null").select("lang", F.array_join("words", " ").alias("phrase"), "words", "f")
    return phrases, kept.where("words is null").select("lang", F.col("f").alias("n"))


def _exact(column: str | Column) -> Column:
    """A long as a decimal: products may pass 64 bits."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every candidate, by the cut with the lowest score, the earliest of equal ones."""
    candidates = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.expr("slice(words, k + 1, size(words))"), " ").alias("right"))
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    both = both.withColumn("times", F.lit(SCALE).cast("decimal(7,0)") * _exact("a")).withColumn("parts", _exact("l") + _exact("r"))
    return both.withColumn("score", F.expr("times div parts")).groupBy("lang", "phrase").agg(
        F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates that no longer candidate around them nearly explains."""
    inner = F.expr(f"""flatten(transform(sequence(2, {ORDER - 1}), m ->
        transform(filter(sequence(1, {ORDER}), i -> m < size(words) and i + m - 1 <= size(words)), i -> array_join(slice(words, i, m), ' '))))""")
    around = candidates.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    gone = F.lit(100).cast("decimal(3,0)") * _exact(F.coalesce("around", F.lit(0))) >= F.lit(covered).cast("decimal(3,0)") * _exact("a")
    return candidates.join(around, ["lang", "phrase"], "left").where(~gone).drop("around")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations."""
    phrases, words = phrase_counts(documents, least)
    kept = uncovered(scored(phrases), covered)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of many lots first, so that no task ranks a whole language.
    lots = kept.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
