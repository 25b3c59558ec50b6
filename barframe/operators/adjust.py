"""Split and bonus adjustment of price history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators.asof import join_nearest

SEARCH_DAYS = 6
TOLERANCE_LN = math.log(1.25)
MAX_RESIDUAL_GAP_PCT = 25.0


def combine_same_day(actions: DataFrame) -> DataFrame:
    """One factor per (ticker, ex_date): the product, as a sum of logarithms."""
    return (
        actions.where("adj_factor is not null and adj_factor > 0")
        .groupBy("ticker", "ex_date")
        .agg(F.exp(F.sum(F.log("adj_factor"))).alias("combined"), F.count(F.lit(1)).alias("n_actions"))
    )


def detect_effective_dates(
    actions: DataFrame, raw_bars: DataFrame, search_days: int = SEARCH_DAYS,
    tolerance: float = TOLERANCE_LN,
) -> DataFrame:
    """Session on which each action really moved the price.

    Each action asks for its 2 x 6 + 1 calendar days, so bars join by equality on
    (ticker, date) instead of all bars of a ticker meeting all of its actions.
    """
    groups = combine_same_day(actions)
    days = groups.select(
        "ticker", "ex_date", "combined",
        F.explode(F.sequence(F.date_sub("ex_date", search_days), F.date_add("ex_date", search_days))).alias("date"),
    )
    seen = days.join(raw_bars.select("ticker", "date", "close"), ["ticker", "date"])
    w = Window.partitionBy("ticker", "ex_date").orderBy("date")
    seen = seen.withColumn("prev", F.lag("close").over(w))
    ok = (F.col("prev") > 0) & (F.col("close") > 0)
    seen = seen.withColumn("ratio", F.when(ok, F.col("close") / F.col("prev")))
    seen = seen.withColumn("err", F.abs(F.log("ratio") - F.log("combined")))
    best = seen.groupBy("ticker", "ex_date").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.min(F.when(F.col("err").isNotNull(), F.struct("err", "date", "ratio"))).alias("b"),
    )
    out = groups.join(best, ["ticker", "ex_date"], "left")
    few = F.coalesce(F.col("n_bars"), F.lit(0)) < 2
    hit = ~few & (F.col("b.err") <= tolerance)
    number = lambda c: F.format_string("%.4f", c)
    note = (
        F.when(few, "no price data in window")
        .when(hit, F.concat(F.lit("matched ratio "), number(F.col("b.ratio")), F.lit(" vs expected "), number(F.col("combined"))))
        .otherwise(F.concat(
            F.lit("no matching gap (best ratio "),
            F.coalesce(F.when(F.col("b.ratio").isNotNull(), number(F.col("b.ratio"))), F.lit("n/a")),
            F.lit(" vs expected "), number(F.col("combined")), F.lit(")"),
        ))
    )
    return out.select(
        "ticker", "ex_date", "combined", "n_actions",
        F.when(hit, F.col("b.date")).alias("effective_date"), note.alias("detection_note"),
    )


def with_effective_dates(actions: DataFrame, detected: DataFrame) -> DataFrame:
    """The found date and note on every single action."""
    return actions.join(
        detected.select("ticker", "ex_date", "effective_date", "detection_note"), ["ticker", "ex_date"], "left"
    )


def drift_histogram(located: DataFrame) -> DataFrame:
    return (
        located.where("effective_date is not null")
        .groupBy(F.datediff("effective_date", "ex_date").cast("long").alias("drift_days"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def back_adjust(raw_bars: DataFrame, located: DataFrame) -> DataFrame:
    """Adjusted OHLC; volume stays raw, ``close_raw`` and the factor are kept.

    Bars and one row per (ticker, effective date) go through one window; the factor of a bar
    is the product over strictly later effective dates. Shares its shuffle with every later
    window by ticker.
    """
    steps = (
        located.where("effective_date is not null and adj_factor is not null and adj_factor > 0")
        .groupBy("ticker", F.col("effective_date").alias("date"))
        .agg(F.sum(F.log("adj_factor")).alias("_ln"))
    )
    both = raw_bars.withColumn("_bar", F.lit(True)).unionByName(
        steps.withColumn("_bar", F.lit(False)), allowMissingColumns=True
    )
    later = (
        Window.partitionBy("ticker").orderBy(F.unix_date("date").cast("long").desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    cum = F.exp(F.coalesce(F.sum("_ln").over(later), F.lit(0.0)))
    bars = both.withColumn("adj_factor", cum).where("_bar")
    keep = [c for c in raw_bars.columns if c not in ("open", "high", "low", "close", "ticker", "date")]
    return bars.select(
        "ticker", "date",
        *[(F.col(c) * F.col("adj_factor")).alias(c) for c in ("open", "high", "low", "close")],
        F.col("close").alias("close_raw"), *keep, "adj_factor",
    )


def adjustment_audit(adj: DataFrame, located: DataFrame, limit_pct: float = MAX_RESIDUAL_GAP_PCT) -> DataFrame:
    """Raw and adjusted gap across each effective date; a large adjusted gap is suspicious."""
    acts = located.where(
        "adj_factor is not null and adj_factor <> 1 and effective_date is not null"
    ).select("ticker", F.col("effective_date").alias("eff"), "adj_factor")
    bars = adj.select("ticker", "date", F.col("close").alias("a"), F.col("close_raw").alias("r"))
    args = dict(probe_key="ticker", probe_date="eff", payload=["a", "r"])
    out = join_nearest(acts, bars, **args, direction="backward", strict=True, prefix="before_")
    out = join_nearest(out, bars, **args, direction="forward", strict=False, prefix="after_")
    gap = lambda x: F.lit(100.0) * (F.col(f"after_{x}") - F.col(f"before_{x}")) / F.nullif(F.col(f"before_{x}"), F.lit(0.0))
    return out.select(
        "ticker", F.col("eff").alias("ex_date"), "adj_factor",
        gap("r").alias("raw_gap_pct"), gap("a").alias("adj_gap_pct"),
        (F.abs(F.coalesce(gap("a"), F.lit(0.0))) > limit_pct).alias("suspicious"),
    )


def largest_adjustments(audit: DataFrame, n: int = 15) -> DataFrame:
    return audit.orderBy(F.abs(F.lit(1.0) - F.col("adj_factor")).desc(), "ticker", "ex_date").limit(n)
