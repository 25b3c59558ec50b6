"""Capacity-limited backtests, paper trades and the trade journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.numbers import r_multiple
from barframe.operators.reports import win_pct

c = F.col


def daily_results(signals: DataFrame, max_positions=(2,), cost: float = 0.20) -> DataFrame:
    """One row per (strategy, day): top N by absolute gap, equal weight 1/N.

    ``signals``: date, ticker, direction, gap_pct, excess_oc. Every N of a sweep shares one
    ranking; a pick counts for each strategy whose limit it meets.
    """
    w = Window.partitionBy("date").orderBy(F.abs("gap_pct").desc(), "ticker")
    picks = signals.withColumn("_r", F.row_number().over(w)).where(c("_r") <= max(max_positions))
    picks = picks.withColumn("strategy", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in max_positions]))).where(
        c("_r") <= c("strategy")
    )
    net = F.when(c("direction") == "short", -c("excess_oc")).otherwise(c("excess_oc")) - cost
    return picks.withColumn("_net", net).groupBy("strategy", "date").agg(
        (F.sum("_net") / F.first("strategy")).alias("day_pct"), F.count(F.lit(1)).alias("n"),
        F.count_if(c("_net") > 0).alias("wins"),
    )


def equity_curve(daily: DataFrame, start: float = 100.0) -> DataFrame:
    """Compounded equity, running peak and drawdown per strategy."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    eq = daily.withColumn("equity", F.lit(start) * F.exp(F.sum(F.log1p(c("day_pct") / 100.0)).over(w)))
    eq = eq.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    return eq.withColumn("drawdown_pct", (c("peak") - c("equity")) / c("peak") * 100.0)


def backtest_summary(curve: DataFrame, start: float = 100.0) -> DataFrame:
    s = curve.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("trades"),
        (F.lit(100.0) * F.sum("wins") / F.sum("n")).alias("win_rate"), F.avg("day_pct").alias("mean_day"),
        F.max_by("equity", "date").alias("equity"), F.max("drawdown_pct").alias("max_drawdown"),
        F.stddev_pop("day_pct").alias("_sd"),
        (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"),
    )
    return s.withColumns({
        "cagr": (F.pow(c("equity") / start, F.lit(1.0) / F.nullif(c("years"), F.lit(0.0))) - 1.0) * 100.0,
        "sharpe": c("mean_day") / F.nullif(c("_sd"), F.lit(0.0)) * F.sqrt(F.lit(252.0)),
    }).drop("_sd")


def yearly_sums(daily: DataFrame) -> DataFrame:
    return daily.groupBy("strategy", F.year("date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("trades"), F.sum("day_pct").alias("sum_pct")
    )


def worst_days(daily: DataFrame, n: int = 5) -> DataFrame:
    return daily.orderBy("day_pct", "date", "strategy").limit(n)


def stress_months(panel: DataFrame, min_gap: float = 3.0, cuts=(250, 500, 800)) -> DataFrame:
    """Months grouped by how many signals they had: mean and worst month of the fade."""
    side = F.when(c("gap_pct") > 0, -1.0).otherwise(1.0)
    rows = panel.where(F.abs("gap_pct") >= min_gap).withColumn("_g", side * c("excess_oc"))
    months = rows.groupBy(F.date_trunc("month", "date").alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_g").alias("_mean"), win_pct("_g").alias("_win")
    )
    a, b, d = cuts
    kind = F.when(c("_n") < a, "a: calm").when(c("_n") < b, "b: normal").when(c("_n") < d, "c: busy").otherwise("d: stress")
    return months.groupBy(kind.alias("month_type")).agg(
        F.count(F.lit(1)).alias("months"), F.avg("_mean").alias("avg_gross"), F.avg("_win").alias("avg_win_pct"),
        F.min("_mean").alias("worst_month"),
    )


# ---- paper trades -----------------------------------------------------------------------


def paper_log(picks: DataFrame) -> DataFrame:
    """Signals as open paper trades; store with ``insert_new`` on (trade_date, ticker)."""
    return picks.select(
        c("date").alias("trade_date"), "ticker", "direction", "gap_pct", (c("t20") / 1e7).alias("turnover_cr"),
        c("entry").alias("assumed_open"), F.lit("open").alias("status"),
    )


def apply_fills(trades: DataFrame, fills: DataFrame) -> DataFrame:
    """Actual fills and their signed slippage (positive is worse)."""
    t = trades.join(fills.select("trade_date", "ticker", "actual_fill"), ["trade_date", "ticker"], "left")
    worse = F.when(c("direction") == "short", c("assumed_open") - c("actual_fill")).otherwise(c("actual_fill") - c("assumed_open"))
    return t.withColumn("slippage_pct", F.lit(100.0) * worse / c("assumed_open"))


def settle(trades: DataFrame, bars: DataFrame, cost: float = 0.20) -> DataFrame:
    """Close open trades at the day's close; without a bar they stay open."""
    px = bars.select(c("date").alias("trade_date"), "ticker", c("close").alias("_px"))
    t = trades.join(px, ["trade_date", "ticker"], "left")
    due = (c("status") == "open") & c("_px").isNotNull()
    raw = F.lit(100.0) * (c("_px") / F.coalesce("actual_fill", "assumed_open") - 1.0)
    gross = F.when(c("direction") == "short", -raw).otherwise(raw)
    return t.withColumns({
        "exit_price": F.when(due, c("_px")), "gross_pct": F.when(due, gross), "net_pct": F.when(due, gross - cost),
        "status": F.when(due, "closed").otherwise(c("status")),
    }).drop("_px")


def paper_report(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return trades.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "closed").alias("closed"), F.avg("net_pct").alias("mean_net"),
        win_pct("net_pct").alias("win_pct"), F.min("net_pct").alias("worst"), F.avg("slippage_pct").alias("mean_slippage"),
    )


def strategy_guard(
    trades: DataFrame, keys: list[str], max_slippage: float = 0.15, min_win: float = 48.0, worst: float = -20.0,
    min_trades: int = 50,
) -> DataFrame:
    """Realised edge against fixed limits; ``halt`` once enough trades breach any of them."""
    r = paper_report(trades, keys)
    r = r.withColumns({
        "slippage_breach": F.coalesce(c("mean_slippage") > max_slippage, F.lit(False)),
        "win_breach": F.coalesce(c("win_pct") < min_win, F.lit(False)),
        "loss_breach": F.coalesce(c("worst") < worst, F.lit(False)),
    })
    any_breach = c("slippage_breach") | c("win_breach") | c("loss_breach")
    return r.withColumn("halt", (c("closed") >= min_trades) & any_breach)


# ---- journal ------------------------------------------------------------------------------


def journal(trades: DataFrame, status: str = "all", limit: int = 100) -> DataFrame:
    """Open trades first, then the newest."""
    if status in ("open", "closed"):
        trades = trades.where(c("closed_at").isNull() if status == "open" else c("closed_at").isNotNull())
    return trades.orderBy(c("closed_at").isNull().desc(), c("opened_at").desc(), "id").limit(min(100, max(1, limit)))


def close_trades(trades: DataFrame, exits: DataFrame) -> DataFrame:
    """Close open trades for which an exit exists; closed ones are left alone."""
    t = trades.join(exits.select("id", c("exit_price").alias("_x"), c("closed_at").alias("_at")), "id", "left")
    due = c("closed_at").isNull() & c("_x").isNotNull()
    return t.withColumns({
        "exit_price": F.when(due, c("_x")).otherwise(c("exit_price")),
        "r_multiple": F.when(due, r_multiple(c("direction"), c("entry"), c("stop"), c("_x"))).otherwise(c("r_multiple")),
        "closed_at": F.when(due, c("_at")).otherwise(c("closed_at")),
    }).drop("_x", "_at")


def journal_stats(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    closed = c("closed_at").isNotNull()
    r = F.coalesce(c("r_multiple"), F.lit(0.0))
    return trades.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~closed).alias("open_count"), F.count_if(closed).alias("closed_count"),
        F.round(F.avg(F.when(closed, r)), 2).alias("avg_r"),
        F.round(F.avg(F.when(closed, F.when(r > 0, 100.0).otherwise(0.0))), 1).alias("win_rate"),
    )
