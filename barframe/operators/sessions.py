"""Session ordinals, trailing measures and offset columns over keyed bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns evaluated exactly once per row.

    The optimiser inlines projected expressions wherever they are used, also into filters. A
    generator over a one-element array is a fence: what is above it sees a plain column.
    """
    packed = F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))
    return df.select("*", F.inline(packed))


def by_ticker(key: str = "ticker", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def with_session_number(bars: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """``sn``: trading-day ordinal per instrument; all "N sessions later" logic uses it."""
    return bars.withColumn("sn", F.row_number().over(by_ticker(key, order)).cast("long"))


def trailing_mean(value: Column, n: int = 20, key: str = "ticker", order: str = "date") -> Column:
    """Mean of the previous ``n`` rows, today excluded; a short frame is allowed."""
    return F.avg(value).over(by_ticker(key, order).rowsBetween(-n, -1))


def full_window(agg: Column, count_of: Column, window, n: int) -> Column:
    """A rolling aggregate that stays NULL until its window holds ``n`` values."""
    return F.when(F.count(count_of).over(window) == n, agg.over(window))


def with_turnover(bars: DataFrame, raw_close: str = "close_raw", n: int = 20) -> DataFrame:
    """``t20``: trailing mean of raw close x volume."""
    return bars.withColumn("t20", trailing_mean(F.col(raw_close) * F.col("volume"), n))


def with_volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    avg = trailing_mean(F.col("volume").cast("double"), n)
    return bars.withColumn("avgvol20", avg).withColumn(
        "vol_ratio", F.col("volume") / F.nullif(F.col("avgvol20"), F.lit(0.0))
    )


def with_previous_close(bars: DataFrame) -> DataFrame:
    return bars.withColumn("prev_close", F.lag("close").over(by_ticker()))


def session_helpers(adj: DataFrame) -> DataFrame:
    """Bars with ordinal, previous close, trailing turnover and volume base in one pass.

    All five windows share one partitioning and order: one shuffle, one sort.
    """
    return with_volume_ratio(with_turnover(with_previous_close(with_session_number(adj))))


def benchmark_series(index_prices: DataFrame, name: str | None = None) -> DataFrame:
    """One index with ordinal ``nsn`` and the 50-session mean including today.

    The window is keyed by index, so it holds one row per trading date.
    """
    df = index_prices if name is None else index_prices.where(F.col("index_name") == name)
    w = Window.partitionBy("index_name").orderBy("date")
    return df.select(
        "index_name", "date", "open", "close",
        F.row_number().over(w).cast("long").alias("nsn"),
        F.avg("close").over(w.rowsBetween(-49, 0)).alias("sma50"),
    )


def with_forward_index(bench: DataFrame, horizons, col: str = "close") -> DataFrame:
    w = Window.partitionBy("index_name").orderBy("date")
    out = bench
    for h in horizons:
        out = out.withColumn(f"n_fwd_{h}", F.lead(col, h).over(w))
    return out


def with_forward_close(bars: DataFrame, horizons) -> DataFrame:
    """Close ``h`` sessions later, for every horizon in one pass (instead of one self-join each)."""
    out = bars
    for h in horizons:
        out = out.withColumn(f"fwd_close_{h}", F.lead("close", h).over(by_ticker()))
    return out


def up_streak(df: DataFrame, value: str, key: str, order: str, out: str) -> DataFrame:
    """Consecutive rises ending at each row: islands between non-rising rows."""
    w = Window.partitionBy(key).orderBy(order)
    rising = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))
    return (
        df.withColumn("_rise", rising)
        .withColumn("_isle", F.sum(F.when(F.col("_rise"), 0).otherwise(1)).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(out, F.row_number().over(Window.partitionBy(key, "_isle").orderBy(order)).cast("long") - 1)
        .drop("_rise", "_isle")
    )


def rolling_rank(df: DataFrame, value: str, n: int, key: str, order: str) -> Column:
    """(x - min) / (max - min) over the last ``n`` rows incl. today; flat range is NULL."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.count(value).over(w) == n, (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def rolling_percentile(value: str, n: int, key: str, order: str) -> Column:
    """Share (in %) of the previous ``n - 1`` values that are <= today's."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), -1)
    before = F.collect_list(value).over(w)
    at_most = F.size(F.filter(before, lambda x: x <= F.col(value)))
    return F.when(
        (F.size(before) == n - 1) & F.col(value).isNotNull(), F.lit(100.0) * at_most / F.lit(float(n - 1))
    )


def rolling_mean(value: str, n: int, key: str, order: str) -> Column:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return full_window(F.avg(value), F.col(value), w, n)


def rolling_std(value: str, lo: int, hi: int, key: str, order: str) -> Column:
    """Sample deviation over rows ``lo..hi`` around today; NULL when incomplete."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(lo, hi)
    return full_window(F.stddev_samp(value), F.col(value), w, hi - lo + 1)
