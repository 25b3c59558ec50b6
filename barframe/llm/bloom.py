"""Bloom filters of 64-bit hashes: bounded in size, they know all they were made of and few others.

For work that may be left undone where a row is surely of no use: what passes is looked at exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import U64

#: Bits a hash at least, while there are no more than MOST_BITS; from there on the filter lets more pass, never fewer.
BITS_EACH, HASHES, MOST_BITS = 12, 4, 1 << 30


def _place(key: Column, k: int, bits: int) -> Column:
    return (key.bitwiseAND(F.lit(0xFFFFFFFF)) + k * F.shiftrightunsigned(key, 32)) % bits


def made_of(keys: DataFrame) -> np.ndarray:
    """The filter of the hashes in the first column of ``keys`` (a written table; it is read twice)."""
    key = F.col(keys.columns[0])
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * keys.count()).bit_length()))
    places = keys.select(F.explode(F.array(*[_place(key, k, bits) for k in range(HASHES)])).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return out


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low, high, size = keys & U64(0xFFFFFFFF), keys >> U64(32), U64(64 * len(bits))
    out = np.ones(len(keys), bool)
    for k in range(HASHES):
        place = (low + U64(k) * high) % size
        out &= (bits[place >> U64(6)] >> (place & U64(63)) & U64(1)).astype(bool)
    return out
