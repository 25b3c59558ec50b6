"""Option chains: forwards, implied volatility, daily surface, buyer studies, fill resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions import options_math as M
from barframe.functions.dates import year_fraction
from barframe.functions.filings import parse_contract_symbol
from barframe.functions.numbers import right_closed_bins
from barframe.operators.reports import win_pct
from barframe.operators.sessions import bind, rolling_mean, rolling_percentile, rolling_rank
from barframe.session import cut

MIN_TTE = 1.0 / 365.0
CONTRACT = ["ticker", "expiry", "strike", "option_type"]

# Study bins.
PREMIUM_EDGES = [0.0, 1.0, 5.0, 20.0, 50.0, 100.0, 300.0, 1e9]
PREMIUM_LABELS = ["<1", "1-5", "5-20", "20-50", "50-100", "100-300", "300+"]
OTM_EDGES = [-99.0, -2.0, -0.5, 0.5, 2.0, 5.0, 99.0]
OTM_LABELS = ["ITM>2%", "ITM.5-2%", "ATM+-.5%", "OTM.5-2%", "OTM2-5%", "OTM>5%"]
DTE_EDGES = [-1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 1e9]
DTE_LABELS = ["0-2d", "3-5d", "6-10d", "11-20d", "21-40d", "40d+"]

c = F.col


def tradeable_options(chain: DataFrame, min_volume: int = 0) -> DataFrame:
    return chain.where(
        c("option_type").isin("CE", "PE") & (c("close") > 0) & (c("underlying") > 0) & (c("volume") >= min_volume)
    )


def implied_forwards(chain: DataFrame, near: int = 6, max_gap: float = 0.05) -> DataFrame:
    """Forward per (ticker, trade_date, expiry) from put-call parity near the money.

    Calls meet puts by a conditional aggregate on the strike, not by a self-join.
    """
    day = ["ticker", "trade_date", "expiry"]
    pairs = chain.groupBy(*day, "strike").agg(
        F.max(F.when(c("option_type") == "CE", c("close"))).alias("ce"),
        F.max(F.when(c("option_type") == "PE", c("close"))).alias("pe"),
        F.max("underlying").alias("und"),
    ).where("ce is not null and pe is not null")
    tte = year_fraction(c("expiry"), c("trade_date"))
    pairs = pairs.where(tte >= MIN_TTE).withColumn(
        "f_impl", c("strike") + (c("ce") - c("pe")) / M.discount(tte)
    )
    w = Window.partitionBy(*day).orderBy(F.abs(c("strike") - c("und")), "strike")
    nearest = pairs.withColumn("_r", F.row_number().over(w)).where(c("_r") <= near)
    fwd = nearest.groupBy(*day).agg(F.median("f_impl").alias("f"), F.max("und").alias("und"))
    stale = F.abs(c("f") / c("und") - 1.0) > max_gap
    return fwd.select(*day, F.when(stale, c("und")).otherwise(c("f")).alias("forward"))


def with_forward(chain: DataFrame, near: int = 6, max_gap: float = 0.05) -> DataFrame:
    """``chain`` with the ``forward`` of ``implied_forwards`` on its own rows; days without one are left out.

    Windows of one contract day each, so a chain that lies by instrument is not shuffled and meets no join.
    """
    day = ["ticker", "trade_date", "expiry"]
    strike = Window.partitionBy(*day, "strike").orderBy("option_type").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chain.withColumns({
        "_ce": F.max(F.when(c("option_type") == "CE", c("close"))).over(strike),
        "_pe": F.max(F.when(c("option_type") == "PE", c("close"))).over(strike),
        "_und": F.max("underlying").over(strike),
        "_once": F.row_number().over(Window.partitionBy(*day, "strike").orderBy("option_type")) == 1,
        "_tte": year_fraction(c("expiry"), c("trade_date")),
    })
    pair = c("_once") & c("_ce").isNotNull() & c("_pe").isNotNull() & (c("_tte") >= MIN_TTE)
    rows = rows.withColumn("_gap", F.when(pair, F.abs(c("strike") - c("_und"))))
    nearest = Window.partitionBy(*day).orderBy(c("_gap").asc_nulls_last(), "strike")
    rows = rows.withColumn("_r", F.when(c("_gap").isNotNull(), F.row_number().over(nearest)))
    whole = Window.partitionBy(*day)
    picked = lambda x: F.when(c("_r") <= near, x)
    rows = rows.withColumns({
        "_f": F.median(picked(c("strike") + (c("_ce") - c("_pe")) / M.discount(c("_tte")))).over(whole),
        "_u": F.max(picked(c("_und"))).over(whole),
    }).where(c("_f").isNotNull())
    stale = F.abs(c("_f") / c("_u") - 1.0) > max_gap
    return rows.select(*chain.columns, F.when(stale, c("_u")).otherwise(c("_f")).alias("forward"))


def _erf(x: np.ndarray) -> np.ndarray:
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = np.polyval([1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592], t) * t
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


@F.pandas_udf(T.DoubleType())
def _implied_vol(price: pd.Series, fwd: pd.Series, strike: pd.Series, tte: pd.Series, call: pd.Series, df: pd.Series) -> pd.Series:
    """Newton steps over a whole Arrow batch, kept inside a bracket that every step narrows.

    The price rises with volatility, so the bracket always holds the root; a step that would leave
    it halves it instead. Rows that are settled to the last digits leave the batch.
    """
    p, f, k, t, d = (s.to_numpy(float) for s in (price, fwd, strike, tte, df))
    side = np.where(call.to_numpy(bool), 1.0, -1.0)
    log_fk, root_t = np.log(f / k), np.sqrt(t)
    iv, at = np.empty(len(p)), np.arange(len(p))
    lo, hi = np.full(len(p), M.IV_LOW), np.full(len(p), M.IV_HIGH)
    x = np.clip(np.sqrt(2.0 * np.abs(log_fk) / t), 0.2, 1.0)
    phi = lambda z: 0.5 * (1.0 + _erf(z / np.sqrt(2.0)))
    for _ in range(2 * M.BISECTION_STEPS):
        spread = np.maximum(x * root_t, 1e-12)
        d1 = (log_fk + 0.5 * x * x * t) / spread
        value = side * d * (f * phi(side * d1) - k * phi(side * (d1 - spread)))
        low = value < p
        lo, hi = np.where(low, x, lo), np.where(low, hi, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x + (p - value) / (d * f * root_t * np.exp(-0.5 * d1 * d1) / np.sqrt(2.0 * np.pi))
        inside = (step > lo) & (step < hi)
        new = np.where(inside, step, 0.5 * (lo + hi))
        done = (np.abs(new - x) <= 1e-13) | (hi - lo <= 1e-13)
        iv[at[done]] = new[done]
        left = ~done
        if not left.any():
            break
        if done.any():
            at, p, f, k, t, d, side, log_fk, root_t, lo, hi, new = (
                v[left] for v in (at, p, f, k, t, d, side, log_fk, root_t, lo, hi, new))
        x = new
    else:
        iv[at] = x
    pinned = (iv <= M.IV_LOW * 1.01) | (iv >= M.IV_HIGH * 0.99)
    return pd.Series(np.where(pinned, np.nan, iv))


def option_iv(chain: DataFrame, min_volume: int = 0) -> DataFrame:
    """Implied volatility, delta and moneyness of every contract-day that has a root."""
    rows = tradeable_options(chain, min_volume)
    rows = with_forward(rows)
    rows = rows.withColumn("tte", year_fraction(c("expiry"), c("trade_date"))).where(c("tte") >= MIN_TTE)
    call = c("option_type") == "CE"
    rows = rows.withColumn("_df", M.discount(c("tte")))
    rows = rows.where(c("close") > c("_df") * M.intrinsic(c("forward"), c("strike"), call) + M.TICK)
    # The root is bound before it is filtered on: a filter pushed below it would solve it again.
    rows = bind(rows, _root=_implied_vol("close", "forward", "strike", "tte", call, "_df"))
    rows = bind(rows, iv=F.nanvl(c("_root"), F.lit(None).cast("double"))).where(c("iv").isNotNull())
    rows = M.with_delta(rows, "delta", c("forward"), c("strike"), c("tte"), c("iv"), call, c("_df"))
    return rows.select(
        *CONTRACT, "trade_date", "close", "underlying", "forward", "tte", "iv", "delta",
        M.moneyness(c("strike"), c("forward")).alias("moneyness"),
    )


def interpolate(df: DataFrame, keys: list[str], x: str, y: str, target, out: str) -> DataFrame:
    """y at x = target per group by the two bracketing points; NULL if not bracketed or < 2 points."""
    point = F.struct(c(x).alias("x"), c(y).alias("y"))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(target).alias("_t"),
        F.max(F.when(c(x) <= target, point)).alias("_lo"), F.min(F.when(c(x) >= target, point)).alias("_hi"),
    )
    lo, hi = c("_lo"), c("_hi")
    value = F.when(lo["x"] == hi["x"], lo["y"]).otherwise(
        lo["y"] + (hi["y"] - lo["y"]) / (hi["x"] - lo["x"]) * (c("_t") - lo["x"])
    )
    return g.select(*keys, F.when((c("_n") >= 2) & lo.isNotNull() & hi.isNotNull(), value).alias(out))


def _interpolated(df: DataFrame, targets: dict[str, tuple[str, Column]]) -> DataFrame:
    """``interpolate`` row by row: ``out`` -> (array of (x, y), target); y at equal x is averaged.

    Brackets are bound before they are used, so an array is gone through once for each of them.
    """
    edges, means = {}, {}

    def bracket(out, points, target):
        at = F.transform(points, lambda p: p["x"])
        edges[f"_{out}_lo"] = F.array_max(F.filter(at, lambda x: x <= target))
        edges[f"_{out}_hi"] = F.array_min(F.filter(at, lambda x: x >= target))
        edges[f"_{out}_many"] = F.array_min(at) < F.array_max(at)

    def mean_at(out, points, end):
        ys = F.filter(points, lambda p: p["x"] == c(f"_{out}_{end}"))
        means[f"_{out}_y{end}"] = F.aggregate(ys, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(ys)

    for out, (points, target) in targets.items():
        bracket(out, points, target)
        mean_at(out, points, "lo")
        mean_at(out, points, "hi")
    df = bind(bind(df, **edges), **means)
    for out, (_, target) in targets.items():
        lo, hi, ylo, yhi = (c(f"_{out}_{x}") for x in ("lo", "hi", "ylo", "yhi"))
        value = F.when(lo == hi, ylo).otherwise(ylo + (yhi - ylo) / (hi - lo) * (target - lo))
        df = df.withColumn(out, F.when(c(f"_{out}_many") & lo.isNotNull() & hi.isNotNull(), value))
    return df.drop(*edges, *means)


def daily_surface(iv: DataFrame, min_rows: int = 4) -> DataFrame:
    """Front/next at-the-money volatility, term slope and 25-delta skew per (ticker, date).

    The rows are gone through once: each expiry's points become one row, which is reduced to a few numbers
    before days are put together. A row holds the contracts of one expiry on one day.
    """
    day, exp = ["ticker", "trade_date"], ["ticker", "trade_date", "expiry"]
    # Rows are dealt by instrument once; expiries, days and the ranks over them then need no further shuffle.
    points = iv.select(*exp, "forward", "underlying", "strike", "iv", "option_type", "delta").repartition("ticker").groupBy(*exp).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("forward").alias("forward"), F.max("underlying").alias("spot"),
        F.collect_list(F.struct("strike", "iv", "option_type", "delta")).alias("_p"),
    )
    leg = lambda kind: F.transform(
        F.filter("_p", lambda p: p["option_type"] == kind), lambda p: F.struct(p["delta"].alias("x"), p["iv"].alias("y")))
    smile = F.transform("_p", lambda p: F.struct(p["strike"].alias("x"), p["iv"].alias("y")))
    points = bind(points, _smile=smile, _put=leg("PE"), _call=leg("CE")).drop("_p").withColumn(
        "n_strikes", F.size(F.array_distinct(F.transform("_smile", lambda p: p["x"]))).cast("long"))
    per_exp = _interpolated(points, {"atm": ("_smile", c("forward"))}).select(*exp, "n_rows", "forward", "spot", "n_strikes", "atm", "_put", "_call")
    rank = Window.partitionBy(*day).orderBy("expiry")
    per_exp = per_exp.withColumns({
        "_rank": F.row_number().over(rank), "next_expiry": F.lead("expiry").over(rank),
        "next_atm_iv": F.lead(F.when(c("n_rows") >= min_rows, c("atm"))).over(rank),
    })
    front = per_exp.where((c("_rank") == 1) & (c("n_rows") >= min_rows) & c("atm").isNotNull())
    # The skew is that of the first expiry alone.
    return _interpolated(front, {"p25": ("_put", F.lit(-0.25)), "c25": ("_call", F.lit(0.25))}).select(
        *day, "spot", c("expiry").alias("front_expiry"), "next_expiry", "forward",
        F.datediff("expiry", "trade_date").cast("long").alias("dte"), c("atm").alias("atm_iv"), "next_atm_iv",
        F.when(c("atm") != 0, c("next_atm_iv") - c("atm")).alias("term_slope"),
        (c("p25") - c("c25")).alias("skew_25d"), "n_strikes",
    )


def surface_ranks(surface: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    """IV rank 20/60 and one-year percentile (today included in its range), optional VIX columns."""
    k, o = "ticker", "trade_date"
    out = surface.withColumns({
        "iv_rank_20d": rolling_rank(surface, "atm_iv", 20, k, o),
        "iv_rank_60d": rolling_rank(surface, "atm_iv", 60, k, o),
        "iv_pctile_252": rolling_percentile("atm_iv", 252, k, o),
    })
    if vix is None:
        return out
    return out.join(vix_features(vix).withColumnRenamed("date", "trade_date"), "trade_date", "left")


def vix_features(vix: DataFrame) -> DataFrame:
    """``vix``: (index_name, date, close), one index."""
    w = Window.partitionBy("index_name").orderBy("date")
    return vix.select(
        "date", c("close").alias("vix"), (c("close") - F.lag("close").over(w)).alias("vix_chg_1d"),
        rolling_mean("close", 5, "index_name", "date").alias("vix_ma5"),
        rolling_mean("close", 20, "index_name", "date").alias("vix_ma20"),
    )


def surface_coverage(ranked: DataFrame) -> DataFrame:
    """Sessions, ranges, medians and the correlation with the volatility index, per ticker."""
    from barframe.operators.quantiles import exact_quantiles, with_quantiles

    stats = ranked.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.min("atm_iv").alias("min_atm"), F.max("atm_iv").alias("max_atm"), F.count("vix").alias("vix_days"),
        F.when(F.count("vix") > 3, F.corr(c("atm_iv") * 100.0, "vix")).alias("corr_vix"),
    )
    ranked = cut(ranked.select("ticker", "atm_iv", "skew_25d", "term_slope"), "surface-ranks")
    for name, col in (("median_atm", "atm_iv"), ("median_skew", "skew_25d"), ("median_slope", "term_slope")):
        stats = with_quantiles(stats, exact_quantiles(ranked, ["ticker"], col, {name: 0.5}), ["ticker"])
    return stats


def buyer_outcomes(chain: DataFrame, hold: int = 5, min_volume: int = 1000) -> DataFrame:
    """Buy at the close, leave ``hold`` sessions later or at intrinsic if the contract ends first.

    A contract that simply reaches the end of the data is settled the same way and flagged.
    """
    rows = tradeable_options(chain)
    w = Window.partitionBy(*CONTRACT).orderBy("trade_date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "exit_close": F.lead("close", hold).over(w),
        "last_under": F.last("underlying").over(whole), "last_date": F.max("trade_date").over(whole),
    })
    call = c("option_type") == "CE"
    ends_first = c("exit_close").isNull() & (c("last_date") > c("trade_date"))
    exit_px = F.when(ends_first, M.intrinsic(c("last_under"), c("strike"), call)).otherwise(c("exit_close"))
    rows = rows.withColumn("exit_px", exit_px).withColumn(
        "cut_by_data_end", ends_first & (c("last_date") < c("expiry"))
    ).where(c("exit_px").isNotNull() & (c("volume") >= min_volume))
    return rows.withColumns({
        "gross": F.lit(100.0) * (c("exit_px") / c("close") - 1.0),
        "net": M.net_option_return(c("close"), c("exit_px")),
        "dte": F.datediff("expiry", "trade_date").cast("long"),
        "otm": M.out_of_the_money_pct(c("strike"), c("underlying"), call),
    }).withColumns({
        "premium_bin": right_closed_bins(c("close"), PREMIUM_EDGES, PREMIUM_LABELS),
        "otm_bin": right_closed_bins(c("otm"), OTM_EDGES, OTM_LABELS),
        "dte_bin": right_closed_bins(c("dte").cast("double"), DTE_EDGES, DTE_LABELS),
    })


def buyer_block(outcomes: DataFrame, key: str) -> DataFrame:
    from barframe.operators.quantiles import exact_quantiles, with_quantiles

    rows = cut(outcomes.where(c(key).isNotNull()).select(key, "close", "gross", "net"), "bought")  # read for the means and for the medians
    stats = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), win_pct("net").alias("win_pct")
    )
    return with_quantiles(stats, exact_quantiles(rows, [key], "close", {"median_premium": 0.5}), [key])


def buyer_pivot(outcomes: DataFrame, row_bin: str = "otm_bin", col_bin: str = "premium_bin", labels=PREMIUM_LABELS) -> DataFrame:
    """Mean net return and cell size crossed by two bins (labels fixed: no extra pass to find them)."""
    return (
        outcomes.where(c(row_bin).isNotNull()).groupBy(row_bin).pivot(col_bin, labels)
        .agg(F.avg("net").alias("net"), F.count("net").alias("n"))
    )


# ---- contract symbols and fills -------------------------------------------------------


def contract_table(symbols: DataFrame, listed: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """Parsed contract symbols with their real expiry.

    A monthly symbol names only a month; its expiry is the last one listed in that month.
    """
    # Bound, so that the symbol is taken apart once and not again for the filter and for each of its terms.
    p = bind(symbols, _p=parse_contract_symbol(symbol_col)).where("_p is not null").select("*", "_p.*").drop("_p")
    last = listed.groupBy(
        c("ticker").alias("underlying"), F.year("expiry").alias("expiry_year"), F.month("expiry").alias("expiry_month")
    ).agg(F.max("expiry").alias("_listed"))
    p = p.join(last, ["underlying", "expiry_year", "expiry_month"], "left")
    return p.withColumn("expiry", F.coalesce("expiry", "_listed")).drop("_listed")


def _met(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """Fills with ``_bars``, the price ranges of their contract's sessions; it has at most those of its own life.

    Both are grouped by contract and not joined: how many sessions a chain holds that is made as it is read,
    a planner can't tell, and it would send them whole to every task. If both lie by instrument, neither moves.
    A fill without a contract meets nothing and is a group of its own.
    """
    unknown = F.greatest(*[c(k).isNull() for k in CONTRACT])
    told = fills.select(*CONTRACT, F.when(unknown, F.xxhash64(*fills.columns)).alias("_lone"), F.lit(None).alias("_bar"), F.struct(
        *[x for x in fills.columns if x not in CONTRACT]).alias("_fill"))
    seen = bars.where(~unknown).select(
        *CONTRACT, F.lit(None).cast("long").alias("_lone"), F.struct("trade_date", "low", "high").alias("_bar"), F.lit(None).alias("_fill"))
    both = seen.unionByName(told).groupBy(*CONTRACT, "_lone").agg(F.collect_list("_bar").alias("_bars"), F.collect_list("_fill").alias("_fills"))
    return both.select(*CONTRACT, "_bars", F.inline("_fills"))


def _hits(price: Column) -> Column:
    """Sessions of ``_bars`` on which ``price`` could have traded; none for a leg without a price."""
    found = F.filter("_bars", lambda b: price.between(b["low"], b["high"]))
    return F.transform(F.when(price != 0, found), lambda b: b["trade_date"])


def _found(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """Fills with the sessions on which either leg could have traded: ``_buy`` and ``_sell``."""
    return bind(_met(fills, bars), _buy=_hits(c("buy")), _sell=_hits(c("sell")), _has=F.size("_bars") > 0).drop("_bars")


def resolve_fills(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """Date and side of undated fills from observed price ranges.

    ``fills``: fill_id, contract columns (expiry may be NULL), buy, sell, pnl. Fills meet the
    sessions of their contract once, in one row; both legs are looked up there.
    """
    out = _found(fills, bars)
    for leg in ("buy", "sell"):
        at = c(f"_{leg}")
        out = out.withColumns({
            f"n_{leg}": F.when(at.isNull(), 0).otherwise(F.size(at)).cast("long"),
            f"{leg}_first": F.array_min(at), f"{leg}_last": F.array_max(at),
        })
    both = (c("n_buy") > 0) & (c("n_sell") > 0)
    long_ = both & (c("buy_last") < c("sell_first"))
    short = both & (c("sell_last") < c("buy_first"))
    status = (
        F.when(c("expiry").isNull(), "no_contract").when(~c("_has"), "no_bars")
        .when((c("buy") == 0) | (c("sell") == 0), "settled").when(long_ | short, "resolved")
        .when(both, "overlapping").otherwise("price_not_found")
    )
    located = c("expiry").isNotNull() & c("_has")
    side = F.when(~located, None).when(c("buy") == 0, "SHORT").when(c("sell") == 0, "LONG").when(long_, "LONG").when(short, "SHORT")
    return out.withColumn("status", status).withColumn("side", side).drop("_has", "_buy", "_sell")


def status_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net"))


def circularity_check(resolved: DataFrame) -> DataFrame:
    """Does the inferred side merely repeat the sign of the profit?"""
    r = resolved.where("status = 'resolved'")
    is_short, is_long = (F.when(c("side") == s, 100.0).otherwise(0.0) for s in ("SHORT", "LONG"))
    return r.agg(
        F.avg(F.when(c("pnl") > 0, is_short)).alias("winners_called_short_pct"),
        F.avg(F.when(c("pnl") <= 0, is_long)).alias("losers_called_long_pct"),
        F.count_if(c("pnl") > 0).alias("winners"), F.count_if(c("pnl") <= 0).alias("losers"),
    )


def fill_session_weights(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """``candidate_session_weights`` of fills that are not resolved yet: they meet the bars once and not twice."""
    dates = F.concat(*[F.coalesce(c(leg), F.array().cast("array<date>")) for leg in ("_buy", "_sell")])
    hits = bind(_found(fills.select(*CONTRACT, "buy", "sell"), bars).select("_buy", "_sell"), _dates=dates).select((F.lit(1.0) / F.size("_dates")).alias("w"), F.explode("_dates").alias("trade_date"))
    return hits.groupBy(c("trade_date").alias("date")).agg(F.sum("w").alias("weight"))


def candidate_session_weights(resolved: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, weight): each fill spreads weight 1 evenly over its candidate sessions.

    A fill meets the sessions of its contract in one row; dates are summed up before they are shuffled.
    """
    per_fill = F.lit(1.0) / (c("n_buy") + c("n_sell"))
    found = resolved.where((c("n_buy") + c("n_sell")) > 0)
    rows = _met(found.select(*CONTRACT, "buy", "sell", per_fill.alias("w")), bars)
    dates = F.concat(*[F.coalesce(_hits(c(leg)), F.array()) for leg in ("buy", "sell")])
    hits = rows.select("w", F.explode(dates).alias("trade_date"))
    return hits.groupBy(c("trade_date").alias("date")).agg(F.sum("w").alias("weight"))
