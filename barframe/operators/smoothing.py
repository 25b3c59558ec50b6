"""Recursive smoothing (EMA, Wilder) without a loop and without Python.

e_t = q * e_(t-1) + a * x_t with q = 1 - a has the closed form
e_t = q^t * (seed + sum_j a * x_j * q^-j): one running sum per instrument. q^-j overflows a
double after about 700 / |ln q| rows, so the sum restarts in blocks of bars. A block is long
enough that the weight of everything before the previous block's own sum is below double
precision, so a block needs just that sum carried in, not a chain of carries.

All averages of a table are computed together: smoothers whose speeds allow a common block
share the windows, so a dozen of them cost one shuffle and three sorts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_GROWTH = 600.0  # largest exponent of q^-j inside a block
_FADED = 36.0  # exp(-36) is below double precision


@dataclass(frozen=True)
class Smoother:
    """``out`` = recursive average of ``value``; NULL before ``period`` values, seeded with their mean."""

    value: str
    period: int
    alpha: float
    out: str

    @property
    def decay(self) -> float:
        return -math.log(1.0 - self.alpha)


def ema(value: str, period: int, out: str) -> Smoother:
    return Smoother(value, period, 2.0 / (period + 1), out)


def wilder(value: str, period: int, out: str) -> Smoother:
    return Smoother(value, period, 1.0 / period, out)


def block_groups(specs: list[Smoother]) -> list[tuple[int, list[Smoother]]]:
    """Smoothers with a common block length: set by the fastest, long enough for the slowest."""
    groups: list[tuple[int, list[Smoother]]] = []
    for s in sorted(specs, key=lambda s: -s.decay):
        if groups and groups[-1][0] * s.decay >= _FADED and groups[-1][0] > s.period:
            groups[-1][1].append(s)
        else:
            groups.append((max(int(_GROWTH / s.decay), s.period + 1), [s]))
    return groups


def smooth(df: DataFrame, specs: list[Smoother], key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds every smoother's column. Leading NULLs of a value do not count as values."""
    trivial = [s for s in specs if s.alpha >= 1.0]
    for size, group in block_groups([s for s in specs if s.alpha < 1.0]):
        df = _smooth_group(df, group, size, key, order)
    return df.withColumns({s.out: F.col(s.value) for s in trivial}) if trivial else df


def _smooth_group(df: DataFrame, specs: list[Smoother], size: int, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = lambda s, part: f"_{s.out}_{part}"
    # 1. Values so far and trailing means (the seed candidates), by instrument.
    df = df.withColumns({
        "_n": F.row_number().over(w),
        **{c(s, "rank"): F.count(s.value).over(so_far) for s in specs},
        **{c(s, "mean"): F.avg(s.value).over(w.rowsBetween(-(s.period - 1), 0)) for s in specs},
    })
    df = df.withColumns({"_blk": F.floor((F.col("_n") - 1) / size), "_pos": (F.col("_n") - 1) % size + 1})
    # 2. Weighted running sums inside each block.
    in_block = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda s, e: F.exp(F.lit(-s.decay) * e)
    scaled = lambda s: F.when(F.col(c(s, "rank")) > s.period, F.lit(s.alpha) * F.col(s.value) * power(s, -F.col("_pos")))
    df = df.withColumns({
        c(s, "own"): F.coalesce(F.sum(scaled(s)).over(in_block), F.lit(0.0)) * power(s, F.col("_pos")) for s in specs
    })
    # 3. Seed and its position; the previous block's closing sum.
    first_at = lambda s: F.min(F.when(F.col(c(s, "rank")) == s.period, F.col("_n")))
    seed = lambda s: F.min_by(F.when(F.col(c(s, "rank")) == s.period, F.col(c(s, "mean"))), F.when(F.col(c(s, "rank")) == s.period, F.col("_n")))
    df = df.withColumns({
        **{c(s, "at"): first_at(s).over(so_far) for s in specs},
        **{c(s, "seed"): seed(s).over(so_far) for s in specs},
        **{c(s, "in"): F.last(F.when(F.col("_pos") == size, F.col(c(s, "own"))), ignorenulls=True).over(before) for s in specs},
    })
    out = {}
    for s in specs:
        age = F.col("_n") - F.col(c(s, "at"))
        start = F.when(age < size, F.col(c(s, "seed")) * power(s, age)).otherwise(0.0)
        carried = F.coalesce(F.col(c(s, "in")) * power(s, F.col("_pos")), F.lit(0.0))
        out[s.out] = F.when(F.col(c(s, "rank")) == s.period, F.col(c(s, "seed"))).when(
            F.col(c(s, "rank")) > s.period, start + carried + F.col(c(s, "own"))
        )
    parts = [c(s, p) for s in specs for p in ("rank", "mean", "own", "at", "seed", "in")]
    return df.withColumns(out).drop("_n", "_blk", "_pos", *parts)
