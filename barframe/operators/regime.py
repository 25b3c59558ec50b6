"""Daily volatility-regime table.

Columns are named by when they can be known: ``open_*`` at the open, bare names at the
close, ``fwd_*`` only later.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.numbers import bucket
from barframe.operators.quantiles import exact_quantiles
from barframe.operators.reports import labelled_means, win_pct
from barframe.operators.sessions import rolling_mean, rolling_percentile, rolling_rank, rolling_std, up_streak

RANGE_TH, GAP_TH, RV_WINDOW = 0.8, 0.6, 20
# Level bands of the volatility index and of its one-year percentile.
LEVELS_FIXED = [(12.0, "calm"), (15.0, "low"), (20.0, "normal"), (25.0, "elevated"), (30.0, "high")]
LEVELS_PCT = [(20.0, "calm"), (40.0, "low"), (60.0, "normal"), (80.0, "elevated"), (95.0, "high")]
MEASURES = ["fwd_abs_1", "fwd_abs_5", "fwd_vix_chg_5"]

c = F.col


def level(value: Column, cuts) -> Column:
    return F.when(value.isNotNull(), bucket(value, cuts, "crisis", how="lt"))


def regime_daily(index_bars: DataFrame, vix: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """``index_bars``: (underlier, date, open, high, low, close); ``vix``: (date, vix).

    ``surface``: (underlier, date, atm_iv, iv_rank_20d, skew_25d, term_slope) in fractions.
    All windows are per underlier over one row per session.
    """
    k, o = "underlier", "date"
    w = Window.partitionBy(k).orderBy(o)
    d = index_bars.join(vix.select("date", "vix"), "date")
    prev = F.lag("close").over(w)
    d = d.withColumns({
        "_prev": prev, "vix_prev": F.lag("vix").over(w),
        "vix_ma5": rolling_mean("vix", 5, k, o), "vix_ma20": rolling_mean("vix", 20, k, o),
        "vix_delta_5d": c("vix") - F.lag("vix", 5).over(w),
        "vix_rank_20d": F.lit(100.0) * rolling_rank(d, "vix", 20, k, o),
        "vix_rank_60d": F.lit(100.0) * rolling_rank(d, "vix", 60, k, o),
        "vix_pctile_252": rolling_percentile("vix", 252, k, o),
        "_lr": F.log(c("close") / prev),
        "fwd_abs_1": F.abs(F.lit(100.0) * (F.lead("close").over(w) / c("close") - 1.0)),
        "fwd_ret_5": F.lit(100.0) * (F.lead("close", 5).over(w) / c("close") - 1.0),
        "fwd_vix_chg_5": F.lead("vix", 5).over(w) - c("vix"),
    })
    d = up_streak(d, "vix", k, o, "vix_up_streak")
    annual = math.sqrt(252.0) * 100.0
    d = d.withColumns({
        "rv20_hist": rolling_std("_lr", -(RV_WINDOW - 1), 0, k, o) * annual,
        "fwd_rv20": rolling_std("_lr", 1, RV_WINDOW, k, o) * annual,
        "open_gap_pct": F.lit(100.0) * (c("open") / c("_prev") - 1.0),
        "range_pct": F.lit(100.0) * (c("high") - c("low")) / c("_prev"),
        "fwd_abs_5": F.abs("fwd_ret_5"),
        "regime_level_fixed": level(c("vix"), LEVELS_FIXED),
        "regime_level_pct": level(c("vix_pctile_252"), LEVELS_PCT),
        "regime_dir": F.when(c("vix") > c("vix_prev"), "rising").when(c("vix") < c("vix_prev"), "falling").otherwise("flat"),
    })
    wide_gap, wide_range = F.abs("open_gap_pct") >= GAP_TH, c("range_pct") >= RANGE_TH
    d = d.withColumns({
        "open_expansion": wide_gap, "expansion_or": wide_range | wide_gap, "expansion_and": wide_range & wide_gap,
    })
    if surface is None:
        for name in ("atm_iv", "iv_rank_20d", "skew_25d", "term_slope"):
            d = d.withColumn(name, F.lit(None).cast("double"))
    else:
        scaled = surface.select("underlier", "date", *[
            (c(x) * 100.0).alias(x) for x in ("atm_iv", "iv_rank_20d", "skew_25d", "term_slope")
        ])
        d = d.join(scaled, ["underlier", "date"], "left")
    d = d.withColumns({"vrp_hist": c("atm_iv") - c("rv20_hist"), "fwd_vrp": c("atm_iv") - c("fwd_rv20")})
    return d.where(c("range_pct").isNotNull()).select(
        "date", "underlier", "close", "open_gap_pct", "open_expansion", "range_pct", "expansion_or", "expansion_and",
        c("vix").alias("vix_close"), "vix_prev", "vix_ma5", "vix_ma20", "vix_delta_5d", "vix_up_streak",
        "vix_rank_20d", "vix_rank_60d", "vix_pctile_252", "regime_level_fixed", "regime_level_pct", "regime_dir",
        "atm_iv", "iv_rank_20d", "skew_25d", "term_slope", "rv20_hist", "vrp_hist", "fwd_rv20", "fwd_vrp",
        "fwd_abs_1", "fwd_abs_5", "fwd_ret_5", "fwd_vix_chg_5",
    )


def contingency(regime: DataFrame) -> DataFrame:
    e = c("expansion_and")
    return labelled_means(regime, [
        ("expansion + VIX rising", e & (c("regime_dir") == "rising")),
        ("expansion + VIX falling", e & (c("regime_dir") == "falling")),
        ("expansion + VIX > MA5", e & (c("vix_close") > c("vix_ma5"))),
        ("expansion + VIX < MA5", e & (c("vix_close") <= c("vix_ma5"))),
        ("all expansion", e), ("baseline", F.lit(True)),
    ], MEASURES)


def level_means(regime: DataFrame) -> DataFrame:
    out = None
    for scheme in ("regime_level_fixed", "regime_level_pct"):
        one = regime.where(c(scheme).isNotNull()).groupBy(c(scheme).alias("level")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("fwd_abs_5").alias("abs5"), F.avg("fwd_vix_chg_5").alias("vix_chg")
        ).withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    return out


def premium_summary(regime: DataFrame, cols=("vrp_hist", "fwd_vrp")) -> DataFrame:
    rows = regime.where(c(cols[0]).isNotNull() & c(cols[1]).isNotNull())
    out = None
    for name in cols:
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(name).alias("mean"), win_pct(name).alias("positive_pct"))
        one = one.join(F.broadcast(exact_quantiles(rows, [], name, {"median": 0.5})), how="left")
        one = one.withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def quartile_means(df: DataFrame, feature: str, outcome: str) -> DataFrame:
    """Mean outcome by quartile of a feature: linear edges, right-closed, lowest included."""
    rows = df.where(c(feature).isNotNull() & c(outcome).isNotNull())
    edges = exact_quantiles(rows, [], feature, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    v = c(feature)
    label = F.when(v <= c("q1"), "Q1").when(v <= c("q2"), "Q2").when(v <= c("q3"), "Q3").otherwise("Q4")
    return rows.join(F.broadcast(edges)).groupBy(label.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean_outcome")
    )


def entry_eligibility(regime: DataFrame, require_both: bool = False) -> DataFrame:
    """Expansion x volatility support to a decision, with the reasons behind it."""
    wide_gap, wide_range = F.abs("open_gap_pct") >= GAP_TH, c("range_pct") >= RANGE_TH
    expansion = c("expansion_and") if require_both else c("expansion_or")
    rising = c("regime_dir") == "rising"
    above = F.coalesce(c("vix_close") > c("vix_ma5"), F.lit(False))
    support = rising | above
    reasons = F.array_compact(F.array(
        F.when(wide_range, "range"), F.when(wide_gap, "gap"), F.when(rising, "vix_rising"), F.when(above, "vix_above_ma5"),
        F.when(~expansion, "quiet"),
    ))
    decision = F.when(~expansion, "skip").when(support, "eligible").otherwise("small")
    return regime.select("date", "underlier", decision.alias("decision"), reasons.alias("reasons"))
