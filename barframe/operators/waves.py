"""Directional waves that end in an undecided bar, and the study of fading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.numbers import bucket, period_label
from barframe.operators.ledger import COST_PCT, HORIZONS, MIN_TURNOVER, excess_columns
from barframe.operators.reports import outcome_report
from barframe.operators.sessions import by_ticker, session_helpers, with_forward_close

# Study grids.
BODY_THRESHOLDS = (0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
GAP_CONTEXT = 4.0
EXTENSIONS = [(5.0, "a: <5%"), (10.0, "b: 5-10%"), (15.0, "c: 10-15%")]
VOLUME_STEPS = [(0.8, "a: quiet"), (1.2, "b: normal"), (2.0, "c: elevated"), (3.0, "d: high")]
LIQUIDITY = [(1e9, "liquid"), (2.5e8, "mid")]

c = F.col


def label_bars(bars: DataFrame) -> DataFrame:
    """'up' = higher high and higher low, 'down' = both lower, else 'none'; first bar NULL."""
    w = by_ticker()
    ph, pl = F.lag("high").over(w), F.lag("low").over(w)
    return bars.withColumn(
        "bar_dir",
        F.when(ph.isNull(), F.lit(None).cast("string"))
        .when((c("high") > ph) & (c("low") > pl), "up")
        .when((c("high") < ph) & (c("low") < pl), "down")
        .otherwise("none"),
    )


def wave_signals(bars: DataFrame, min_len: int = 3, min_bars: int = 60) -> DataFrame:
    """Waves of at least ``min_len`` bars that end in a neither-bar.

    Islands of equal labels; a direct reversal starts a new island and never signals. Gap
    columns come from rows before the island, so they are taken before the split.
    """
    w = by_ticker()
    df = bars.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(c("_bars") >= min_bars)
    df = label_bars(df).withColumns({
        "_pc": F.lag("close").over(w), "_po": F.lag("open").over(w), "_ppc": F.lag("close", 2).over(w),
    })
    changed = F.when(c("bar_dir").eqNullSafe(F.lag("bar_dir").over(w)), 0).otherwise(1)
    df = df.withColumn("_ch", changed).withColumn(
        "_isle", F.sum("_ch").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    isle = Window.partitionBy("ticker", "_isle").orderBy("date")
    first = lambda x: F.first(x).over(isle.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({
        "_len": F.row_number().over(isle).cast("long"), "_fo": first("open"),
        "_bc": first("_pc"), "_bo": first("_po"), "_bbc": first("_ppc"),
    })
    prev = lambda x: F.lag(x).over(w)
    df = df.withColumns({
        "_wd": prev("bar_dir"), "_wl": prev("_len"), "_wfo": prev("_fo"), "_wbc": prev("_bc"),
        "_wbo": prev("_bo"), "_wbbc": prev("_bbc"), "_wc": prev("close"),
    })
    span = c("high") - c("low")
    hits = df.where(
        (c("bar_dir") == "none") & c("_wd").isin("up", "down") & (c("_wl") >= min_len) & (span > 0) & (c("open") > 0)
    )
    pct = lambda a, b: (c(a) - c(b)) / c(b) * 100.0
    return hits.select(
        "ticker", c("date").alias("signal_date"),
        F.when(c("_wd") == "up", "short").otherwise("long").alias("direction"),
        c("_wd").alias("wave_dir"), c("_wl").alias("wave_len"),
        pct("_wc", "_wfo").alias("wave_move_pct"), (F.abs(c("close") - c("open")) / span).alias("body_ratio"),
        (span / c("open") * 100.0).alias("range_pct"),
        pct("_wfo", "_wbc").alias("start_gap_pct"), pct("_wbo", "_wbbc").alias("prior_gap_pct"),
    )


def wave_distribution(signals: DataFrame) -> DataFrame:
    return signals.groupBy("wave_dir").agg(
        F.count(F.lit(1)).alias("n"), F.avg("wave_len").alias("avg_len"), F.avg("wave_move_pct").alias("avg_move_pct"),
        F.avg("body_ratio").alias("avg_body_ratio"), F.count_if(c("body_ratio") < 0.30).alias("body_lt_030"),
    )


def _open_entries(adj: DataFrame, index_prices: DataFrame, horizons, min_turnover: float) -> DataFrame:
    """Bars as entry points at the open, with benchmark legs and forward closes."""
    bars = with_forward_close(session_helpers(adj), horizons)
    wn = Window.partitionBy("index_name").orderBy("date")
    bench = index_prices.select(
        "date", c("open").alias("n_open"), *[F.lead("close", h).over(wn).alias(f"n_fwd_{h}") for h in horizons]
    )
    return bars.join(bench, "date").where((c("open") > 0) & (c("n_open") > 0) & (c("t20") >= min_turnover)).select(
        "ticker", c("date").alias("entry_date"), c("open").alias("entry_open"), c("sn").alias("entry_sn"), "t20",
        "n_open", *[f"fwd_close_{h}" for h in horizons], *[f"n_fwd_{h}" for h in horizons],
    )


def price_fades(
    signals: DataFrame, adj: DataFrame, index_prices: DataFrame, horizons=HORIZONS, cost: float = COST_PCT,
    min_turnover: float = MIN_TURNOVER,
) -> DataFrame:
    """Enter the fade at the next session's open; signed excess per horizon."""
    bars = session_helpers(adj)
    at = bars.select("ticker", c("date").alias("signal_date"), (c("sn") + 1).alias("entry_sn"), c("vol_ratio").alias("signal_vol_ratio"))
    entry = _open_entries(adj, index_prices, horizons, min_turnover)
    return signals.join(at, ["ticker", "signal_date"]).join(entry, ["ticker", "entry_sn"]).select(
        *signals.columns, "signal_vol_ratio", "t20", "entry_date", "entry_open",
        *excess_columns(horizons, "entry_open", "n_open", "direction", cost),
    )


def random_control(
    adj: DataFrame, index_prices: DataFrame, share: int = 100, h: int = 5, cost: float = COST_PCT,
    min_turnover: float = MIN_TURNOVER,
) -> DataFrame:
    """Same mechanics on a repeatable 1-in-``share`` draw of liquid days, both directions.

    The draw takes the md5 of the bar's key below a bound, so a rerun or a lost task picks the same days.
    """
    picks = session_helpers(adj).where(c("t20") >= min_turnover).where(
        F.substring(F.md5(F.concat_ws("|", "ticker", c("date").cast("string"))), 1, 4) < f"{65536 // share:04x}"
    )
    both = picks.select(
        "ticker", c("date").alias("pick_date"), (c("sn") + 1).alias("entry_sn"),
        F.explode(F.array(F.lit("long"), F.lit("short"))).alias("direction"),
    )
    entry = _open_entries(adj, index_prices, (h,), float("-inf"))
    return both.join(entry, ["ticker", "entry_sn"]).select(
        "ticker", "pick_date", "direction", *excess_columns((h,), "entry_open", "n_open", "direction", cost)
    )


def threshold_sweep(outcomes: DataFrame, thresholds=BODY_THRESHOLDS) -> DataFrame:
    """All thresholds in one pass: a row counts under every threshold it passes."""
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: c("body_ratio") < t)
    rows = outcomes.withColumn("threshold", F.explode(passed))
    return outcome_report(rows, ["threshold", "wave_dir"], "exc_5", extra={"mean_10": F.avg("exc_10")})


def gap_context(outcomes: DataFrame, gap: float = GAP_CONTEXT, body: float = 0.30) -> DataFrame:
    up = (c("wave_dir") == "up") & (c("start_gap_pct") >= gap)
    down = (c("wave_dir") == "down") & (c("start_gap_pct") <= -gap)
    return outcome_report(
        outcomes.where((c("body_ratio") < body) & (up | down)), ["wave_dir"], "exc_5", extra={"mean_10": F.avg("exc_10")}
    )


def out_of_sample(outcomes: DataFrame, split: str, body: float = 0.30) -> DataFrame:
    rows = outcomes.where(c("body_ratio") < body).withColumn("period", period_label(c("entry_date"), split))
    return outcome_report(rows, ["period", "wave_dir"], "exc_5", median=False)


def cut_by(outcomes: DataFrame, cut: str) -> DataFrame:
    """Secondary cuts: wave length, extension, signal-day volume, liquidity."""
    key = {
        "length": F.least(c("wave_len"), F.lit(6).cast("long")).cast("string"),
        "extension": bucket(F.abs("wave_move_pct"), EXTENSIONS, "d: 15%+", how="lt"),
        "volume": F.when(c("signal_vol_ratio").isNotNull(), bucket(c("signal_vol_ratio"), VOLUME_STEPS, "e: climax", how="lt")),
        "liquidity": bucket(c("t20"), LIQUIDITY, "thin"),
    }[cut]
    return outcome_report(outcomes.withColumn("cut", key), ["wave_dir", "cut"], "exc_5")
