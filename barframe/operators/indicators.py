"""Technical indicators on every bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators.sessions import by_ticker, full_window
from barframe.operators.smoothing import ema, smooth, wilder

INDICATORS = (
    "ema20", "ema50", "ema200", "avg_vol20", "atr14", "pct_from_52w_high", "rsi14",
    "sma20", "sma20_prev", "close_prev", "roc20", "rsi7", "rsi7_prev",
    "stoch_k", "stoch_k_prev", "weekly_trend",
)

c = F.col


def sma(value: str, period: int) -> Column:
    w = by_ticker().rowsBetween(-(period - 1), 0)
    return full_window(F.avg(value), c(value), w, period)


def roc(period: int = 20) -> Column:
    before = F.lag("close", period).over(by_ticker())
    return F.when(before > 0, (c("close") - before) / before * 100.0)


def pct_from_high(lookback: int = 252) -> Column:
    high = F.max("high").over(by_ticker().rowsBetween(-(lookback - 1), 0))
    return F.when(high > 0, (c("close") - high) / high * 100.0)


def with_changes(bars: DataFrame) -> DataFrame:
    """Inputs of the Wilder averages: gain, loss and true range; NULL on the first bar."""
    bars = bars.withColumn("_prev", F.lag("close").over(by_ticker()))
    change, known = c("close") - c("_prev"), c("_prev").isNotNull()
    tr = F.greatest(c("high") - c("low"), F.abs(c("high") - c("_prev")), F.abs(c("low") - c("_prev")))
    return bars.withColumns({
        "_gain": F.when(known, F.greatest(change, F.lit(0.0))), "_loss": F.when(known, F.greatest(-change, F.lit(0.0))),
        "_tr": F.when(known, tr),
    }).drop("_prev")


def rsi_value(gain: Column, loss: Column) -> Column:
    """Flat is 50, no losses 100; exact zeros survive the smoothing, so the tests are exact."""
    value = F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss)
    )
    return F.when(gain.isNotNull(), value)


def with_ema(bars: DataFrame, period: int, out: str, value: str = "close") -> DataFrame:
    return smooth(bars, [ema(value, period, out)])


def with_rsi(bars: DataFrame, period: int, out: str) -> DataFrame:
    df = smooth(with_changes(bars), [wilder("_gain", period, "_g"), wilder("_loss", period, "_l")])
    return df.withColumn(out, rsi_value(c("_g"), c("_l"))).drop("_gain", "_loss", "_tr", "_g", "_l")


def with_atr(bars: DataFrame, period: int = 14, out: str = "atr14") -> DataFrame:
    return smooth(with_changes(bars), [wilder("_tr", period, out)]).drop("_gain", "_loss", "_tr")


def raw_stochastic(k: int) -> Column:
    """%K of the last ``k`` bars; a flat range counts as 50."""
    w = by_ticker().rowsBetween(-(k - 1), 0)
    lo, hi = F.min("low").over(w), F.max("high").over(w)
    raw = F.when(hi - lo > 0, (c("close") - lo) / (hi - lo) * 100.0).otherwise(50.0)
    return F.when(F.count(F.lit(1)).over(w) == k, raw)


def with_slow_stochastic(
    bars: DataFrame, k: int = 7, d: int = 10, out: str = "stoch_k", extra_bar: bool = False
) -> DataFrame:
    """Mean over ``d`` of raw %K over ``k``.

    The first value appears at bar ``k + d - 1``; with ``extra_bar`` (the live snapshot's
    rule) one bar later.
    """
    df = bars.withColumn("_raw_k", raw_stochastic(k)).withColumn(out, sma("_raw_k", d))
    if extra_bar:
        df = df.withColumn(out, F.when(F.row_number().over(by_ticker()) >= k + d, c(out)))
    return df.drop("_raw_k")


def trend(fast: Column, slow: Column, band_pct: float = 0.1) -> Column:
    diff = (fast - slow) / F.nullif(slow, F.lit(0.0)) * 100.0
    return F.when(diff > band_pct, "UP").when(diff < -band_pct, "DOWN").when(diff.isNotNull(), "FLAT")


def indicator_history(bars: DataFrame, min_bars: int = 60, skip_first: bool = True) -> DataFrame:
    """All indicators for every (ticker, date): instruments with enough bars, from bar two.

    One shuffle by ticker; windows are gathered into few passes, each doing many columns.
    """
    df = with_changes(bars).withColumns({
        "_bars": F.count(F.lit(1)).over(Window.partitionBy("ticker")), "_no": F.row_number().over(by_ticker()),
        "close_prev": F.lag("close").over(by_ticker()), "sma20": sma("close", 20), "avg_vol20": sma("volume", 20),
        "pct_from_52w_high": pct_from_high(), "roc20": roc(20), "_raw_k": raw_stochastic(7),
    })
    df = smooth(df, [
        ema("close", 20, "ema20"), ema("close", 50, "ema50"), ema("close", 200, "ema200"),
        wilder("_gain", 7, "_g7"), wilder("_loss", 7, "_l7"), wilder("_gain", 14, "_g14"), wilder("_loss", 14, "_l14"),
        wilder("_tr", 14, "atr14"),
    ])
    df = df.withColumns({
        "rsi7": rsi_value(c("_g7"), c("_l7")), "rsi14": rsi_value(c("_g14"), c("_l14")), "stoch_k": sma("_raw_k", 10),
        "weekly_trend": trend(c("ema20"), c("ema50")),
    })
    df = df.withColumns({f"{x}_prev": F.lag(x).over(by_ticker()) for x in ("sma20", "rsi7", "stoch_k")})
    df = df.where((c("_bars") >= min_bars) & (c("_no") >= (2 if skip_first else 1)))
    return df.drop("_bars", "_no", "_raw_k", "_gain", "_loss", "_tr", "_g7", "_l7", "_g14", "_l14")


def latest_snapshot(bars: DataFrame, min_bars: int = 1) -> DataFrame:
    """Indicator set of each instrument that traded on the latest date.

    Full history is used: cutting the look-back would change the recursive values. A missing
    average leaves the trend label 'FLAT' here, as the snapshot table has no NULL label.
    """
    latest = bars.agg(F.max("date").alias("date"))
    hist = indicator_history(bars, min_bars=min_bars, skip_first=False)
    # The stochastic needs one more bar in a snapshot than in the history.
    hist = hist.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    hist = hist.join(F.broadcast(latest), "date", "left_semi")  # one row
    return (
        hist.withColumn("stoch_k", F.when(c("_bars") >= 17, c("stoch_k")))
        .withColumn("weekly_trend", F.coalesce("weekly_trend", F.lit("FLAT")))
        .select("ticker", "date", "close", "volume", *INDICATORS)
    )
