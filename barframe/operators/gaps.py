"""Opening-gap studies on daily bars and intraday paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.dates import exchange_date
from barframe.functions.numbers import bucket, period_label
from barframe.operators.ledger import MIN_TURNOVER
from barframe.operators.reports import tail_stats, win_pct
from barframe.operators.sessions import session_helpers, with_previous_close, with_turnover

COST_INTRADAY = 0.20
# Study grids.
STOPS = (2.0, 3.0, 5.0, 7.0, 10.0)
SLIPPAGES = (0.0, 0.3, 0.6)
UP_GAPS = [(10.0, "f: 10%+"), (7.0, "e: 7-10%"), (5.0, "d: 5-7%"), (3.0, "c: 3-5%"), (2.0, "b: 2-3%")]
DOWN_GAPS = [(-10.0, "f: -10%+"), (-7.0, "e: -7 to -10%"), (-5.0, "d: -5 to -7%"), (-3.0, "c: -3 to -5%"), (-2.0, "b: -2 to -3%")]
VOLUMES = [(4.0, "vol 4x+"), (2.0, "vol 2-4x")]

c = F.col


def not_locked() -> Column:
    """A bar that traded through a range; locked limit days cannot be entered."""
    return c("high") > c("low") * 1.001


def gap_pct() -> Column:
    return F.lit(100.0) * (c("open") / c("prev_close") - 1.0)


def gap_panel(adj: DataFrame, index_prices: DataFrame, min_turnover: float = MIN_TURNOVER) -> DataFrame:
    """Liquid stock-days with gap, open-to-close move, benchmark move, excess and volume ratio."""
    idx = index_prices.select("date", c("open").alias("n_open"), c("close").alias("n_close"))
    rows = session_helpers(adj).join(idx, "date").where(
        (c("t20") >= min_turnover) & (c("open") > 0) & (c("prev_close") > 0) & (c("n_open") > 0)
    )
    stock = F.lit(100.0) * (c("close") / c("open") - 1.0)
    bench = F.lit(100.0) * (c("n_close") / c("n_open") - 1.0)
    return rows.select(
        "ticker", "date", "open", "high", "low", "close", "prev_close", gap_pct().alias("gap_pct"),
        stock.alias("stock_oc"), bench.alias("index_oc"), (stock - bench).alias("excess_oc"), "vol_ratio", "t20",
    )


def day_parts(adj: DataFrame) -> DataFrame:
    """Overnight gap and intraday drift of every bar."""
    return with_previous_close(adj).where((c("prev_close") > 0) & (c("open") > 0)).select(
        "ticker", "date", gap_pct().alias("overnight_pct"),
        (F.lit(100.0) * (c("close") / c("open") - 1.0)).alias("intraday_pct"),
    )


def no_signal_baseline(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("n"), F.avg(-c("excess_oc")).alias("mean_short_excess"))


def fade_table(panel: DataFrame, key: Column, name: str, side: str, cost: float = COST_INTRADAY) -> DataFrame:
    """Gross, net and edge over the measured no-signal baseline, per bucket.

    The baseline is one row of the same panel, so it follows the data.
    """
    gain = -c("excess_oc") if side == "short" else c("excess_oc")
    base = no_signal_baseline(panel).select(c("mean_short_excess").alias("_b"))
    mirror = F.lit(1.0 if side == "short" else -1.0)
    cells = panel.withColumn(name, key).where(c(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gain).alias("gross_excess"), win_pct(gain).alias("win_pct")
    )
    return cells.join(F.broadcast(base)).select(
        name, "n", "gross_excess", (c("gross_excess") - cost).alias("net_excess"),
        (c("gross_excess") - mirror * c("_b")).alias("edge_over_baseline"), "win_pct",
    )


def up_gap_fade(panel: DataFrame, min_gap: float = 1.0) -> DataFrame:
    key = F.when(c("gap_pct") >= min_gap, bucket(c("gap_pct"), UP_GAPS, "a: 1-2%"))
    return fade_table(panel, key, "gap_bucket", "short")


def down_gap_fade(panel: DataFrame, min_gap: float = 1.0) -> DataFrame:
    key = F.when(c("gap_pct") <= -min_gap, bucket(c("gap_pct"), DOWN_GAPS, "a: -1 to -2%", how="le"))
    return fade_table(panel, key, "gap_bucket", "long")


def out_of_sample_fade(panel: DataFrame, split: str, min_gap: float = 5.0) -> DataFrame:
    return fade_table(panel, F.when(c("gap_pct") >= min_gap, period_label(c("date"), split)), "period", "short")


def volume_climax_fade(panel: DataFrame, min_gap: float = 3.0) -> DataFrame:
    key = F.when(
        (c("gap_pct") >= min_gap) & c("vol_ratio").isNotNull(), bucket(c("vol_ratio"), VOLUMES, "vol <2x")
    )
    return fade_table(panel, key, "vol_bucket", "short")


def gap_signals(adj: DataFrame, min_gap: float = 3.0, min_turnover: float = 1e9) -> DataFrame:
    """Executable fades: what is known at the open, on days that were not locked."""
    rows = with_turnover(with_previous_close(adj))
    return rows.where(
        (c("prev_close") > 0) & (c("open") > 0) & (c("t20") >= min_turnover) & not_locked()
        & (F.abs(gap_pct()) >= min_gap)
    ).select(
        "ticker", "date", F.when(c("open") > c("prev_close"), "short").otherwise("long").alias("direction"),
        c("open").alias("entry"), c("close").alias("exit_close"), gap_pct().alias("gap_pct"), "t20",
    )


def daily_top_signals(signals: DataFrame, max_positions: int = 2) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.abs("gap_pct").desc(), "ticker")
    return signals.withColumn("pick", F.row_number().over(w).cast("long")).where(c("pick") <= max_positions)


def intraday_range(intraday: DataFrame, interval: str = "60m") -> DataFrame:
    """High and low of each (ticker, exchange date): all a touch test needs."""
    return intraday.where(c("interval") == interval).groupBy("ticker", exchange_date("ts").alias("date")).agg(
        F.max("high").alias("day_high"), F.min("low").alias("day_low")
    )


def hour_sequence(intraday: DataFrame, interval: str = "60m") -> DataFrame:
    """Bar ordinal within each session (a partition is one ticker's one day)."""
    rows = intraday.where(c("interval") == interval).withColumn("date", exchange_date("ts"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("ticker", "date").orderBy("ts")).cast("long"))


def with_path(signals: DataFrame, intraday: DataFrame, interval: str = "60m") -> DataFrame:
    """Signals that have intraday bars on their day (semi-join)."""
    days = intraday.where(c("interval") == interval).select("ticker", exchange_date("ts").alias("date"))
    return signals.join(days.distinct(), ["ticker", "date"], "left_semi")


def stop_grid(
    signals: DataFrame, intraday: DataFrame, stops=STOPS, slippages=SLIPPAGES, cost: float = COST_INTRADAY,
    interval: str = "60m",
) -> DataFrame:
    """Net result of each signal under every stop x slippage.

    A touch in any bar exits at the trigger price, so the first touch needs no ordering: the
    day's high and low decide. Bars are reduced to one row per day before the join.
    """
    base = signals.join(intraday_range(intraday, interval), ["ticker", "date"])
    grid = F.array(*[
        F.struct(F.lit(s).alias("stop_pct"), F.lit(x).alias("slip_pct")) for s in stops for x in slippages
    ])
    rows = base.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")
    short = c("direction") == "short"
    side = F.when(short, -1.0).otherwise(1.0)
    trigger = c("entry") * (F.lit(1.0) - side * c("stop_pct") / 100.0)
    hit = F.when(short, c("day_high") >= trigger).otherwise(c("day_low") <= trigger)
    fill = trigger * (F.lit(1.0) - side * c("slip_pct") / 100.0)
    result = lambda px: side * F.lit(100.0) * (px / c("entry") - 1.0) - cost
    return rows.withColumn("net_no_stop", result(c("exit_close"))).withColumn(
        "net", F.when(hit, result(fill)).otherwise(c("net_no_stop"))
    )


def stop_report(grid: DataFrame) -> DataFrame:
    stopped = F.lit(100.0) * F.avg(F.when(F.abs(c("net") - c("net_no_stop")) > 1e-9, 1.0).otherwise(0.0))
    return tail_stats(grid, ["stop_pct", "slip_pct"], "net", extra={"stopped_pct": stopped})


def hourly_fade(signals: DataFrame, intraday: DataFrame, interval: str = "60m") -> DataFrame:
    """Mean result of leaving at the end of each bar of the session."""
    rows = signals.drop("open", "close").join(
        hour_sequence(intraday, interval).select("ticker", "date", "seq", c("close").alias("bar_close")), ["ticker", "date"]
    )
    side = F.when(c("direction") == "short", -1.0).otherwise(1.0)
    gain = side * F.lit(100.0) * (c("bar_close") / c("entry") - 1.0)
    return rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.avg(gain).alias("mean_fade"))


def decay_table(panel: DataFrame, regime: DataFrame, edges: tuple[float, float], min_gap: float = 3.0,
                cost: float = COST_INTRADAY) -> DataFrame:
    """Net fade by year and trailing-volatility bucket of the benchmark."""
    vol = c("rv20_hist")
    rows = panel.where(F.abs("gap_pct") >= min_gap).join(regime.select("date", "rv20_hist"), "date").where(vol.isNotNull())
    side = F.when(c("gap_pct") > 0, -1.0).otherwise(1.0)
    return rows.groupBy(
        F.year("date").cast("long").alias("era"),
        F.when(vol < edges[0], "low").when(vol < edges[1], "mid").otherwise("high").alias("vol_regime"),
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(side * c("excess_oc") - cost).alias("mean_net"))
