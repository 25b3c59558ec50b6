"""Shared parts of the text operators: reading tables, Arrow maps over whole texts, word hashing.

Words are hashed straight from the UTF-8 buffers that Arrow hands over, a chunk of documents at a
time, so a task holds a few megabytes of text and never a Python object for each word.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.session import configure

#: Word gaps of the contracts: space and \x09-\x0D.
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one vectorised step works on (a longer document is a step of its own).
CHUNK_BYTES = 1 << 20
#: Rows handed to Python at once; bounds a worker's memory also where texts are long.
ARROW_ROWS = 500

_rng = np.random.default_rng(20240613)
#: Two independent linear hashes of byte strings: a random 64-bit number for each byte, a random odd base.
BYTES_1, BYTES_2 = (_rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2))
BASE_1, BASE_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")  # written steps are mostly text
    return spark


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done and written.

    Spark drops a shuffle's files when the driver's garbage collector finds that nothing refers to it any
    more. Between large steps that is asked for, so that the disk holds one step's files and not all.
    """
    for _ in range(2):  # the first round frees what Python still named, the second what hung on it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where the input has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``CHUNK_BYTES`` of text; a null text stays null."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(text)))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[min(stop, len(ends)) - 1]


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column as one byte array, and where each begins (one more than rows); null is empty."""
    lengths = _lengths(column)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if not bounds[-1]:
        return np.empty(0, np.uint8), bounds
    data = np.frombuffer(column.buffers()[2], np.uint8)
    if offsets[-1] - offsets[0] == bounds[-1]:
        return data[offsets[0] : offsets[-1]], bounds
    return np.concatenate([data[a : a + n] for a, n in zip(offsets[:-1], lengths, strict=True)]), bounds  # bytes below a null


class Words:
    """Where the words of a chunk are. ``first``: number of words before each document (one more than documents)."""

    def __init__(self, column: pa.Array, gap: np.ndarray = GAP):
        self.data, self.bounds = text_bytes(column)
        n = len(self.data)
        if not n:
            self.starts = self.ends = np.empty(0, np.int64)
            self.first = np.zeros(len(self.bounds), np.int64)
            return
        between = gap[self.data]
        edge = np.ones(n + 1, bool)  # a word may begin here: text begins, or a gap lies before
        edge[1:n] = between[:-1]
        edge[self.bounds] = True
        self.starts = np.flatnonzero(edge[:-1] & ~between)
        close = np.ones(n, bool)
        close[:-1] = between[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds <= n)]
        close[inner - 1] = True
        self.ends = np.flatnonzero(close & ~between) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    @property
    def per_document(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, second: bool = False, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``lower`` folds A-Z, ``second`` is an independent hash."""
        if not len(self.starts):
            return np.empty(0, U64)
        of_byte, base = (BYTES_2, BASE_2) if second else (BYTES_1, BASE_1)
        if lower:
            of_byte = of_byte.copy()
            of_byte[65:91] = of_byte[97:123]
        lengths = self.ends - self.starts
        before = np.cumsum(lengths) - lengths
        places = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), base, U64))
        values = of_byte[self.data[np.repeat(self.starts, lengths) + places]] * powers[places]
        return mixed(np.add.reduceat(values, before) + lengths.astype(U64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(words: np.ndarray, first: np.ndarray, width: int, base: np.uint64 = BASE_1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and document of every run of ``width`` words that stays within a document.

    Returns (hashes, positions in ``words``, document numbers), in text order.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    total, power = np.zeros(n, U64), U64(1)
    for k in range(width):
        total += words[k : k + n] * power
        power = U64((int(power) * int(base)) & (2**64 - 1))
    counts = np.maximum(np.diff(first) - width + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[:-1][docs] + inside
    return mixed(total[at]), at, docs


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
