"""Option chains, fills, volatility regime."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions import options_math as M
from barframe.functions.filings import parse_contract_symbol
from barframe.operators import options, regime, reports
from barframe.plans import q_bars  # noqa: F401
from barframe.plans.registry import define, query
from barframe.plans.sql_twins import CTES, ncdf

c = F.col
DAY = "ticker, trade_date, expiry"

# ---- forwards and implied volatility ----------------------------------------------------------
define("parity", f"""SELECT {DAY}, strike, max(close) FILTER (WHERE option_type = 'CE') AS ce, max(close) FILTER (WHERE option_type = 'PE') AS pe, max(underlying) AS und FROM chain GROUP BY {DAY}, strike""")
define("forwards", f"""SELECT {DAY}, CASE WHEN abs(f / und - 1e0) > 5e-2 THEN und ELSE f END AS forward FROM (SELECT {DAY}, quantile_cont(f, 0.5) AS f, max(und) AS und FROM (
    SELECT *, strike + (ce - pe) / exp(-0.065e0 * (expiry - trade_date) / 365e0) AS f, row_number() OVER (PARTITION BY {DAY} ORDER BY abs(strike - und), strike) AS rk FROM parity
    WHERE ce IS NOT NULL AND pe IS NOT NULL AND (expiry - trade_date) / 365e0 >= 1e0 / 365e0) WHERE rk <= 6 GROUP BY {DAY})""")


# Volatility is read from traded contracts only, and so are the forwards behind it.
for _name in ("parity", "forwards"):
    define(f"{_name}_traded", CTES[_name].replace("FROM chain", "FROM chain WHERE volume >= 300").replace("FROM parity", "FROM parity_traded"))


@query("implied_forwards", "D1 J13 J14 W16", "SELECT * FROM forwards", "forward")
def _(t):
    return options.implied_forwards(t.chain)


define("iv_in", f"""SELECT c.*, forward, (expiry - trade_date) / 365e0 AS tte, exp(-0.065e0 * (expiry - trade_date) / 365e0) AS df, CASE option_type WHEN 'CE' THEN 1e0 ELSE -1e0 END AS side,
    ln(forward / strike) AS lf, sqrt((expiry - trade_date) / 365e0) AS st FROM chain c JOIN forwards_traded USING ({DAY}) WHERE volume >= 300 AND close > 0 AND expiry > trade_date""")
define("iv_ok", "SELECT * FROM iv_in WHERE close > df * greatest(0e0, side * (forward - strike)) + 5e-2")



# The root: sixty halvings, each keeping the lower end. A list of one element binds a name.
def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_UNIT = "side * df * (forward * {0} - strike * {1})"
_PRICE = _let("d", "(lf + 5e-1 * m * m * tte) / greatest(m * st, 1e-12)", _let("y", "side * d", _let("z", "side * (d - greatest(m * st, 1e-12))", _UNIT.format(ncdf("y"), ncdf("z")))))
_HALF = "[5e-3] || [4.995e0 / pow(2e0, i) FOR i IN range(1, 61)]"
define("iv_fit", f"SELECT *, list_reduce({_HALF}, lambda lo, w: {_let('m', 'lo + w', f'CASE WHEN {_PRICE} < close THEN m ELSE lo END')}) + 4.995e0 / pow(2e0, 61) AS iv FROM iv_ok")
define("iv_all", f"""SELECT ticker, expiry, strike, option_type, trade_date, close, underlying, forward, tte, iv, side * df * {ncdf('side * d1')} AS delta, strike / forward - 1e0 AS moneyness
    FROM (SELECT *, (lf + 5e-1 * iv * iv * tte) / greatest(iv * st, 1e-12) AS d1 FROM iv_fit WHERE iv > 5e-3 * 1.01e0 AND iv < 5e0 * 0.99e0)""")


@query("option_implied_vol", "D2 X13 X14 X15 X11", "SELECT * FROM iv_all", "strike close underlying forward tte iv delta moneyness")
def _(t):
    return options.option_iv(t.chain, 300)


# Pricing at the recovered volatility must give the price back.
@query("implied_vol_round_trip", "D2 X14", "SELECT ticker, trade_date, expiry, strike, option_type, close AS repriced FROM iv_all", "repriced", digits=2)
def _(t):
    rows, call = options.option_iv(t.chain, 300), c("option_type") == "CE"
    return M.with_black76(rows, "repriced", c("forward"), c("strike"), c("tte"), c("iv"), call, M.discount(c("tte"))).select(
        "ticker", "trade_date", "expiry", "strike", "option_type", "repriced")


@query("black76_prices", "X13 X14 X17 X18", f"""SELECT {DAY}, strike, option_type, close AS price, greatest(0e0, CASE option_type WHEN 'CE' THEN underlying - strike ELSE strike - underlying END) AS intrinsic,
    CASE option_type WHEN 'CE' THEN 1e0 ELSE -1e0 END * 1e2 * (strike / underlying - 1e0) AS otm, greatest(5e-2, 5e-3 * close) / close AS half_spread FROM chain""", "strike price intrinsic otm half_spread")
def _(t):
    call = c("option_type") == "CE"
    return t.chain.select(
        "ticker", "trade_date", "expiry", "strike", "option_type", c("close").alias("price"), M.intrinsic(c("underlying"), c("strike"), call).alias("intrinsic"),
        M.out_of_the_money_pct(c("strike"), c("underlying"), call).alias("otm"), M.half_spread(c("close")).alias("half_spread"))


def _interpolated(src: str, keys: str) -> str:
    """y at the target t of (x, y, t) by the two points around it."""
    return f"""SELECT {keys}, CASE WHEN n >= 2 AND lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo = hi THEN ylo ELSE ylo + (yhi - ylo) / (hi - lo) * (t - lo) END END AS y FROM (
    SELECT {keys}, count(*) AS n, max(t) AS t, max(x) FILTER (WHERE x <= t) AS lo, min(x) FILTER (WHERE x >= t) AS hi,
    arg_max(y, x) FILTER (WHERE x <= t) AS ylo, arg_min(y, x) FILTER (WHERE x >= t) AS yhi FROM ({src}) GROUP BY {keys})"""


define("sf_exp", f"""SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY expiry) AS rk FROM (
    SELECT {DAY}, count(*) AS n_rows, count(DISTINCT strike) AS n_strikes, max(forward) AS forward, max(underlying) AS spot FROM iv_all GROUP BY {DAY})""")
define("sf_atm", _interpolated(f"SELECT {DAY}, strike AS x, avg(iv) AS y, max(forward) AS t FROM iv_all GROUP BY {DAY}, strike", DAY))
for _leg, _type, _at in (("sf_put", "PE", "-0.25e0"), ("sf_call", "CE", "0.25e0")):
    define(_leg, _interpolated(f"SELECT ticker, trade_date, delta AS x, avg(iv) AS y, {_at} AS t FROM iv_all JOIN (SELECT {DAY} FROM sf_exp WHERE rk = 1 AND n_rows >= 4) USING ({DAY}) WHERE option_type = '{_type}' GROUP BY ALL", "ticker, trade_date"))
define("surface_days", f"""SELECT f.ticker, f.trade_date, f.spot, f.expiry AS front_expiry, x.expiry AS next_expiry, f.forward, (f.expiry - f.trade_date)::BIGINT AS dte, a.y AS atm_iv,
    CASE WHEN x.n_rows >= 4 THEN b.y END AS next_atm_iv, CASE WHEN a.y <> 0 THEN CASE WHEN x.n_rows >= 4 THEN b.y END - a.y END AS term_slope, p.y - k.y AS skew_25d, f.n_strikes
    FROM sf_exp f JOIN sf_atm a ON (a.ticker, a.trade_date, a.expiry) = (f.ticker, f.trade_date, f.expiry)
    LEFT JOIN sf_exp x ON x.ticker = f.ticker AND x.trade_date = f.trade_date AND x.rk = 2 LEFT JOIN sf_atm b ON (b.ticker, b.trade_date, b.expiry) = (x.ticker, x.trade_date, x.expiry)
    LEFT JOIN sf_put p ON p.ticker = f.ticker AND p.trade_date = f.trade_date LEFT JOIN sf_call k ON k.ticker = f.ticker AND k.trade_date = f.trade_date
    WHERE f.rk = 1 AND f.n_rows >= 4 AND a.y IS NOT NULL""")
_sd = "spot forward atm_iv next_atm_iv term_slope skew_25d"


def _back(n: int, by: str = "PARTITION BY ticker ORDER BY trade_date") -> str:
    return f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rank(x: str, n: int, over: str) -> str:
    return f"CASE WHEN count({x}) OVER {over} = {n} THEN ({x} - min({x}) OVER {over}) / nullif(max({x}) OVER {over} - min({x}) OVER {over}, 0) END"


define("vix_days", f"""SELECT date, close AS vix, close - lag(close) OVER (ORDER BY date) AS vix_chg_1d, CASE WHEN count(close) OVER {_back(5, 'ORDER BY date')} = 5 THEN avg(close) OVER {_back(5, 'ORDER BY date')} END AS vix_ma5,
    CASE WHEN count(close) OVER {_back(20, 'ORDER BY date')} = 20 THEN avg(close) OVER {_back(20, 'ORDER BY date')} END AS vix_ma20 FROM vix_x""")
define("surface_ranked", f"""SELECT s.*, v.* EXCLUDE (date) FROM (SELECT * EXCLUDE (earlier), CASE WHEN len(earlier) = 251 THEN 1e2 * len(list_filter(earlier, lambda x: x <= atm_iv)) / 251e0 END AS iv_pctile_252 FROM (
    SELECT *, {_rank('atm_iv', 20, _back(20))} AS iv_rank_20d, {_rank('atm_iv', 60, _back(60))} AS iv_rank_60d,
    list(atm_iv) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING) AS earlier FROM surface_days)) s LEFT JOIN vix_days v ON v.date = s.trade_date""")


@query("iv_surface", "D3 X16", "SELECT * FROM surface_days", _sd)
def _(t):
    return options.daily_surface(options.option_iv(t.chain, 300))


# The interpolation itself, on given columns: price against strike at the underlying.
define("curve", f"SELECT {DAY}, strike, avg(close) AS y, max(underlying) AS x0 FROM chain WHERE option_type = 'CE' GROUP BY {DAY}, strike")


@query("interpolate_at_target", "X16", f"""SELECT {DAY}, CASE WHEN n >= 2 AND lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo = hi THEN ylo ELSE ylo + (yhi - ylo) / (hi - lo) * (x0 - lo) END END AS y FROM (
    SELECT {DAY}, count(*) AS n, max(x0) AS x0, max(strike) FILTER (WHERE strike <= x0) AS lo, min(strike) FILTER (WHERE strike >= x0) AS hi,
    arg_max(y, strike) FILTER (WHERE strike <= x0) AS ylo, arg_min(y, strike) FILTER (WHERE strike >= x0) AS yhi FROM curve GROUP BY {DAY})""", "y")
def _(t):
    k = ["ticker", "trade_date", "expiry"]
    curve = t.chain.where("option_type = 'CE'").groupBy(*k, "strike").agg(F.avg("close").alias("iv"), F.max("underlying").alias("x0"))
    return options.interpolate(curve, k, "strike", "iv", c("x0"), "y")


def stored_surface(t):
    def build():
        return options.surface_ranks(options.daily_surface(options.option_iv(t.chain, 300)), t.vix_x)

    return t.stored("surface", build)


@query("iv_ranks", "D4 W7 W8 W9", "SELECT * FROM surface_ranked", f"{_sd} iv_rank_20d iv_rank_60d iv_pctile_252 vix vix_chg_1d vix_ma5 vix_ma20")
def _(t):
    return stored_surface(t)


@query("surface_coverage", "D5 A16", """SELECT ticker, count(*) AS sessions, min(trade_date) AS first_date, max(trade_date) AS last_date, min(atm_iv) AS min_atm, max(atm_iv) AS max_atm, count(vix) AS vix_days,
    CASE WHEN count(vix) > 3 THEN corr(atm_iv * 1e2, vix) END AS corr_vix, quantile_cont(atm_iv, 0.5) AS median_atm, quantile_cont(skew_25d, 0.5) AS median_skew, quantile_cont(term_slope, 0.5) AS median_slope FROM surface_ranked GROUP BY 1""",
       "min_atm max_atm corr_vix median_atm median_skew median_slope")
def _(t):
    return options.surface_coverage(stored_surface(t))


# ---- buyer study --------------------------------------------------------------------------------
define("held", """SELECT *, CASE WHEN exit_close IS NULL AND last_date > trade_date THEN greatest(0e0, CASE option_type WHEN 'CE' THEN last_under - strike ELSE strike - last_under END) ELSE exit_close END AS exit_px,
    exit_close IS NULL AND last_date > trade_date AND last_date < expiry AS cut_by_data_end FROM (
    SELECT *, lead(close, 1) OVER w AS exit_close, max(trade_date) OVER p AS last_date, last_value(underlying) OVER (PARTITION BY ticker, expiry, strike, option_type ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_under
    FROM chain WINDOW w AS (PARTITION BY ticker, expiry, strike, option_type ORDER BY trade_date), p AS (PARTITION BY ticker, expiry, strike, option_type))""")
define("bought", """SELECT *, 1e2 * (exit_px / close - 1e0) AS gross, 1e2 * (exit_px * (1e0 - greatest(5e-2, 5e-3 * greatest(exit_px, 5e-2)) / greatest(exit_px, 5e-2)) / (close * (1e0 + greatest(5e-2, 5e-3 * close) / close)) - 1e0) AS net,
    (expiry - trade_date)::BIGINT AS dte, CASE option_type WHEN 'CE' THEN 1e0 ELSE -1e0 END * 1e2 * (strike / underlying - 1e0) AS otm,
    CASE WHEN close <= 0 THEN NULL WHEN close <= 1 THEN '<1' WHEN close <= 5 THEN '1-5' WHEN close <= 20 THEN '5-20' WHEN close <= 50 THEN '20-50' WHEN close <= 100 THEN '50-100' WHEN close <= 300 THEN '100-300' ELSE '300+' END AS premium_bin FROM held
    WHERE exit_px IS NOT NULL AND volume >= 400""")
define("binned", """SELECT *, CASE WHEN otm <= -99 THEN NULL WHEN otm <= -2 THEN 'ITM>2%' WHEN otm <= -0.5e0 THEN 'ITM.5-2%' WHEN otm <= 0.5e0 THEN 'ATM+-.5%' WHEN otm <= 2 THEN 'OTM.5-2%' WHEN otm <= 5 THEN 'OTM2-5%' WHEN otm <= 99 THEN 'OTM>5%' END AS otm_bin,
    CASE WHEN dte <= -1 THEN NULL WHEN dte <= 2 THEN '0-2d' WHEN dte <= 5 THEN '3-5d' WHEN dte <= 10 THEN '6-10d' WHEN dte <= 20 THEN '11-20d' WHEN dte <= 40 THEN '21-40d' ELSE '40d+' END AS dte_bin FROM bought""")


def bought(t):
    return options.buyer_outcomes(t.chain, hold=1, min_volume=400)


@query("option_buyer_outcomes", "D6 W14 X17 X18 P10 D7", "SELECT ticker, trade_date, expiry, strike, option_type, exit_px, gross, net, dte, otm, premium_bin, otm_bin, dte_bin, cut_by_data_end FROM binned", "strike exit_px gross net otm")
def _(t):
    return bought(t).select("ticker", "trade_date", "expiry", "strike", "option_type", "exit_px", "gross", "net", "dte", "otm", "premium_bin", "otm_bin", "dte_bin", "cut_by_data_end")


for _bin in ("premium_bin", "otm_bin", "dte_bin"):
    query(f"option_buyer_by_{_bin[:-4]}", "D6 D7 A12", f"SELECT {_bin}, count(*) AS n, avg(gross) AS gross, avg(net) AS net, 1e2 * avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win_pct, quantile_cont(close, 0.5) AS median_premium FROM binned WHERE {_bin} IS NOT NULL GROUP BY 1", "gross net win_pct median_premium")(
        lambda t, k=_bin: options.buyer_block(bought(t), k)
    )

_labels = options.PREMIUM_LABELS


@query("option_buyer_pivot", "D6 A11", "SELECT otm_bin, " + ", ".join(f"avg(net) FILTER (WHERE premium_bin = '{x}') AS \"{x}_net\", nullif(count(net) FILTER (WHERE premium_bin = '{x}'), 0) AS \"{x}_n\"" for x in _labels) + " FROM binned WHERE otm_bin IS NOT NULL GROUP BY 1",
       " ".join(f'"{x}_net"' for x in _labels))
def _(t):
    p = options.buyer_pivot(bought(t))
    return p.select("otm_bin", *[c(f"`{x}_net`") for x in _labels], *[F.nullif(c(f"`{x}_n`"), F.lit(0)).alias(f"{x}_n") for x in _labels])


# ---- contracts and fills ----------------------------------------------------------------------------
@query("contract_symbols", "D8 D9 J3", "SELECT symbol, ticker, year(expiry)::BIGINT AS y, month(expiry)::BIGINT AS m, expiry, strike, option_type, 'monthly' AS expiry_kind FROM fills", "strike")
def _(t):
    k = t.contracts
    return k.select("symbol", "ticker", c("expiry_year").cast("long").alias("y"), c("expiry_month").cast("long").alias("m"), "expiry", "strike", "option_type", "expiry_kind")


@query("weekly_symbols", "D8", """SELECT ticker, trade_date, strike, option_type, trade_date AS parsed FROM chain WHERE day(expiry - 1) < 32 AND expiry = last_day(trade_date)""", "strike")
def _(t):
    ch = t.chain.where(c("expiry") == F.last_day("trade_date"))
    m = F.month("trade_date")
    code = F.when(m < 10, m.cast("string")).when(m == 10, "O").when(m == 11, "N").otherwise("D")
    sym = F.concat("ticker", F.date_format("trade_date", "yy"), code, F.date_format("trade_date", "dd"), c("strike").cast("long").cast("string"), "option_type")
    p = parse_contract_symbol(sym)
    return ch.withColumn("p", p).select("ticker", "trade_date", "strike", "option_type", c("p.expiry").alias("parsed"))


_ck = "ticker, expiry, strike, option_type"
define("leg_hits", f"""SELECT symbol, leg, count(*) AS n, min(trade_date) AS d0, max(trade_date) AS d1 FROM (SELECT symbol, {_ck}, 'b' AS leg, buy AS px FROM fills WHERE buy <> 0 UNION ALL SELECT symbol, {_ck}, 's', sell FROM fills WHERE sell <> 0) l
    JOIN chain b USING ({_ck}) WHERE px BETWEEN low AND high GROUP BY 1, 2""")
define("resolved_t", """SELECT *, CASE WHEN buy = 0 OR sell = 0 THEN 'settled' WHEN n_buy > 0 AND n_sell > 0 AND (b1 < s0 OR s1 < b0) THEN 'resolved' WHEN n_buy > 0 AND n_sell > 0 THEN 'overlapping' ELSE 'price_not_found' END AS status,
    CASE WHEN buy = 0 THEN 'SHORT' WHEN sell = 0 THEN 'LONG' WHEN n_buy > 0 AND n_sell > 0 AND b1 < s0 THEN 'LONG' WHEN n_buy > 0 AND n_sell > 0 AND s1 < b0 THEN 'SHORT' END AS side FROM (
    SELECT f.symbol, f.buy, f.sell, f.pnl, coalesce(b.n, 0) AS n_buy, coalesce(s.n, 0) AS n_sell, b.d0 AS b0, b.d1 AS b1, s.d0 AS s0, s.d1 AS s1 FROM fills f
    LEFT JOIN (SELECT * FROM leg_hits WHERE leg = 'b') b USING (symbol) LEFT JOIN (SELECT * FROM leg_hits WHERE leg = 's') s USING (symbol))""")


def undated(t):
    """Fills dealt as the chain is: they meet its sessions where those are made."""
    return t.contracts.select(*options.CONTRACT, "symbol", "buy", "sell", "pnl").repartition(t.chain_tasks, "ticker")


def resolved(t):
    return options.resolve_fills(undated(t), t.chain)


@query("resolve_fills", "D10 J9 S13", "SELECT symbol, n_buy, n_sell, status, side FROM resolved_t")
def _(t):
    return resolved(t).select("symbol", "n_buy", "n_sell", "status", "side")


@query("fill_status", "A19", "SELECT status, side, count(*) AS n, sum(pnl) AS net FROM resolved_t GROUP BY 1, 2", "net", digits=2)
def _(t):
    return options.status_counts(resolved(t))


@query("fill_circularity", "A20", """SELECT 1e2 * avg(CASE WHEN side = 'SHORT' THEN 1e0 ELSE 0e0 END) FILTER (WHERE pnl > 0) AS winners_called_short_pct, 1e2 * avg(CASE WHEN side = 'LONG' THEN 1e0 ELSE 0e0 END) FILTER (WHERE pnl <= 0) AS losers_called_long_pct,
    count(*) FILTER (WHERE pnl > 0) AS winners, count(*) FILTER (WHERE pnl <= 0) AS losers FROM resolved_t WHERE status = 'resolved'""", "winners_called_short_pct losers_called_long_pct")
def _(t):
    return options.circularity_check(resolved(t))


define("cand_dates", f"""SELECT trade_date AS date, sum(1e0 / (n_buy + n_sell)) AS weight FROM (SELECT symbol, {_ck}, buy AS px FROM fills WHERE buy <> 0 UNION ALL SELECT symbol, {_ck}, sell FROM fills WHERE sell <> 0) l
    JOIN chain b USING ({_ck}) JOIN resolved_t r USING (symbol) WHERE px BETWEEN low AND high GROUP BY 1""")


@query("candidate_session_weights", "D11 A17", "SELECT * FROM cand_dates", "weight")
def _(t):
    return options.fill_session_weights(undated(t), t.chain)


@query("option_book", "A23", """SELECT option_type, CASE WHEN buy < 50 THEN 'cheap' ELSE 'expensive' END AS price_class, count(*) AS n, sum(pnl) AS net, 1e2 * avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS win_pct, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gross_profit, sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS gross_loss,
    sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS profit_factor, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss FROM fills GROUP BY 1, 2""", "net win_pct gross_profit gross_loss profit_factor avg_win avg_loss", digits=2)
def _(t):
    return reports.profit_book(t.contracts, ["option_type", F.when(c("buy") < 50, "cheap").otherwise("expensive").alias("price_class")])


# ---- regime -------------------------------------------------------------------------------------------
_W = "(PARTITION BY underlier ORDER BY date)"


def _r(n):
    return f"(PARTITION BY underlier ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_lv = lambda x, cuts: f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} < {e} THEN '{n}'" for e, n in cuts) + " ELSE 'crisis' END"
define("reg0", f"""SELECT *, 1e2 * (open / prev - 1e0) AS open_gap_pct, 1e2 * (high - low) / prev AS range_pct, ln(close / prev) AS lr FROM (
    SELECT e.ticker AS underlier, e.date, e.open, e.high, e.low, e.close, v.close AS vix, lag(e.close) OVER (PARTITION BY e.ticker ORDER BY e.date) AS prev FROM eod_x e JOIN vix_x v ON v.date = e.date)""")
define("reg1", f"""SELECT *, list(vix) OVER (PARTITION BY underlier ORDER BY date ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING) AS earlier, sum(CASE WHEN rise THEN 0 ELSE 1 END) OVER {_W} AS isle FROM (SELECT *, coalesce(vix > vix_prev, FALSE) AS rise FROM (SELECT *, lag(vix) OVER {_W} AS vix_prev FROM reg0))""")
define("reg2", "SELECT *, CASE WHEN len(earlier) = 251 THEN 1e2 * len(list_filter(earlier, lambda x: x <= vix)) / 251e0 END AS vix_pctile_252 FROM reg1")
define("reg", f"""SELECT date, underlier, close, open_gap_pct, abs(open_gap_pct) >= 0.6e0 AS open_expansion, range_pct, range_pct >= 0.8e0 OR abs(open_gap_pct) >= 0.6e0 AS expansion_or, range_pct >= 0.8e0 AND abs(open_gap_pct) >= 0.6e0 AS expansion_and,
    vix AS vix_close, vix_prev, CASE WHEN count(vix) OVER {_r(5)} = 5 THEN avg(vix) OVER {_r(5)} END AS vix_ma5, CASE WHEN count(vix) OVER {_r(20)} = 20 THEN avg(vix) OVER {_r(20)} END AS vix_ma20,
    vix - lag(vix, 5) OVER {_W} AS vix_delta_5d, (row_number() OVER (PARTITION BY underlier, isle ORDER BY date) - 1)::BIGINT AS vix_up_streak,
    CASE WHEN count(vix) OVER {_r(20)} = 20 THEN 1e2 * (vix - min(vix) OVER {_r(20)}) / nullif(max(vix) OVER {_r(20)} - min(vix) OVER {_r(20)}, 0) END AS vix_rank_20d,
    1e2 * {_rank('vix', 60, _r(60))} AS vix_rank_60d, vix_pctile_252, {_lv('vix', regime.LEVELS_FIXED)} AS regime_level_fixed, {_lv('vix_pctile_252', regime.LEVELS_PCT)} AS regime_level_pct, CASE WHEN vix > vix_prev THEN 'rising' WHEN vix < vix_prev THEN 'falling' ELSE 'flat' END AS regime_dir,
    CASE WHEN count(lr) OVER {_r(20)} = 20 THEN stddev_samp(lr) OVER {_r(20)} * sqrt(252e0) * 1e2 END AS rv20_hist,
    CASE WHEN count(lr) OVER nx = 20 THEN stddev_samp(lr) OVER nx * sqrt(252e0) * 1e2 END AS fwd_rv20, abs(1e2 * (lead(close) OVER {_W} / close - 1e0)) AS fwd_abs_1,
    abs(1e2 * (lead(close, 5) OVER {_W} / close - 1e0)) AS fwd_abs_5, 1e2 * (lead(close, 5) OVER {_W} / close - 1e0) AS fwd_ret_5, lead(vix, 5) OVER {_W} - vix AS fwd_vix_chg_5
    FROM reg2 WINDOW nx AS (PARTITION BY underlier ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) QUALIFY range_pct IS NOT NULL""")
_rd = "close open_gap_pct range_pct vix_close vix_prev vix_ma5 vix_ma20 vix_delta_5d vix_rank_20d vix_rank_60d vix_pctile_252 rv20_hist fwd_rv20 fwd_abs_1 fwd_abs_5 fwd_ret_5 fwd_vix_chg_5"
_rc = "date underlier close open_gap_pct open_expansion range_pct expansion_or expansion_and vix_close vix_prev vix_ma5 vix_ma20 vix_delta_5d vix_up_streak vix_rank_20d vix_rank_60d vix_pctile_252 regime_level_fixed regime_level_pct regime_dir rv20_hist fwd_rv20 fwd_abs_1 fwd_abs_5 fwd_ret_5 fwd_vix_chg_5".split()


def regime_table(t):
    bars = t.eod_x.select(c("ticker").alias("underlier"), "date", "open", "high", "low", "close")
    return t.stored("regime", lambda: regime.regime_daily(bars, t.vix_x.select("date", c("close").alias("vix"))))


@query("regime_daily", "R1 J11 W9 W10 W11 W12 W13 P12", f"SELECT {', '.join(_rc)} FROM reg", _rd, digits=6)
def _(t):
    return regime_table(t).select(*_rc)


define("reg_iv", """SELECT r.*, 1e2 * s.atm_iv AS atm_iv, 1e2 * s.iv_rank_20d AS iv_rank_20d, 1e2 * s.skew_25d AS skew_25d, 1e2 * s.term_slope AS term_slope, 1e2 * s.atm_iv - rv20_hist AS vrp_hist, 1e2 * s.atm_iv - fwd_rv20 AS fwd_vrp
    FROM reg r LEFT JOIN surface_ranked s ON s.ticker = r.underlier AND s.trade_date = r.date""")


def regime_with_surface(t):
    bars = t.eod_x.select(c("ticker").alias("underlier"), "date", "open", "high", "low", "close")
    s = stored_surface(t).withColumnsRenamed({"ticker": "underlier", "trade_date": "date"})
    return t.stored("regime_iv", lambda: regime.regime_daily(bars, t.vix_x.select("date", c("close").alias("vix")), s))


@query("regime_with_surface", "R1 J12", "SELECT * FROM reg_iv", f"{_rd} atm_iv iv_rank_20d skew_25d term_slope vrp_hist fwd_vrp", digits=6)
def _(t):
    return regime_with_surface(t)


define("reg_cells", """SELECT r.*, unnest(list_filter([CASE WHEN expansion_and AND regime_dir = 'rising' THEN 'expansion + VIX rising' END, CASE WHEN expansion_and AND regime_dir = 'falling' THEN 'expansion + VIX falling' END,
    CASE WHEN expansion_and AND vix_close > vix_ma5 THEN 'expansion + VIX > MA5' END, CASE WHEN expansion_and AND vix_close <= vix_ma5 THEN 'expansion + VIX < MA5' END, CASE WHEN expansion_and THEN 'all expansion' END, 'baseline'], lambda x: x IS NOT NULL)) AS cell FROM reg r""")


@query("regime_contingency", "R2 A13", "SELECT cell, count(*) AS n, avg(fwd_abs_1) AS fwd_abs_1, avg(fwd_abs_5) AS fwd_abs_5, avg(fwd_vix_chg_5) AS fwd_vix_chg_5 FROM reg_cells GROUP BY 1 HAVING count(*) >= 3", "fwd_abs_1 fwd_abs_5 fwd_vix_chg_5")
def _(t):
    return regime.contingency(regime_table(t))


@query("regime_levels", "R2 A14 P12", " UNION ALL ".join(f"SELECT {s} AS level, '{s}' AS scheme, count(*) AS n, avg(fwd_abs_5) AS abs5, avg(fwd_vix_chg_5) AS vix_chg FROM reg WHERE {s} IS NOT NULL GROUP BY 1" for s in ("regime_level_fixed", "regime_level_pct")), "abs5 vix_chg")
def _(t):
    return regime.level_means(regime_table(t))


@query("feature_quartiles", "R2 A15", """SELECT CASE WHEN rv20_hist <= q1 THEN 'Q1' WHEN rv20_hist <= q2 THEN 'Q2' WHEN rv20_hist <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile, count(*) AS n, avg(fwd_rv20) AS mean_outcome FROM reg,
    (SELECT quantile_cont(rv20_hist, 0.25) AS q1, quantile_cont(rv20_hist, 0.5) AS q2, quantile_cont(rv20_hist, 0.75) AS q3 FROM reg WHERE rv20_hist IS NOT NULL AND fwd_rv20 IS NOT NULL) WHERE rv20_hist IS NOT NULL AND fwd_rv20 IS NOT NULL GROUP BY 1""", "mean_outcome")
def _(t):
    return regime.quartile_means(regime_table(t), "rv20_hist", "fwd_rv20")


@query("volatility_premium", "R2", "SELECT measure, count(*) AS n, avg(x) AS mean, 1e2 * avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END) AS positive_pct, quantile_cont(x, 0.5) AS median FROM (SELECT unnest(['vrp_hist', 'fwd_vrp']) AS measure, unnest([vrp_hist, fwd_vrp]) AS x FROM reg_iv WHERE vrp_hist IS NOT NULL AND fwd_vrp IS NOT NULL) GROUP BY 1", "mean positive_pct median")
def _(t):
    return regime.premium_summary(regime_with_surface(t))


@query("entry_eligibility", "R3", """SELECT date, underlier, CASE WHEN NOT expansion_or THEN 'skip' WHEN regime_dir = 'rising' OR coalesce(vix_close > vix_ma5, FALSE) THEN 'eligible' ELSE 'small' END AS decision,
    concat_ws('|', CASE WHEN range_pct >= 0.8e0 THEN 'range' END, CASE WHEN abs(open_gap_pct) >= 0.6e0 THEN 'gap' END, CASE WHEN regime_dir = 'rising' THEN 'vix_rising' END, CASE WHEN vix_close > vix_ma5 THEN 'vix_above_ma5' END, CASE WHEN NOT expansion_or THEN 'quiet' END) AS reasons FROM reg""")
def _(t):
    return regime.entry_eligibility(regime_table(t)).withColumn("reasons", F.array_join("reasons", "|"))


define("ov", """SELECT r.*, w.weight FROM reg r LEFT JOIN cand_dates w USING (date)
    WHERE date BETWEEN (SELECT min(date) FROM cand_dates JOIN reg USING (date)) AND (SELECT max(date) FROM cand_dates JOIN reg USING (date))""")


@query("regime_overlay", "D11 A17", """SELECT facet, value, 1e2 * w / tw AS share_pct, 1e2 * n / tn AS base_pct, (1e2 * w / tw) / (1e2 * n / tn) AS lift FROM (
    SELECT facet, value, coalesce(sum(weight), 0e0) AS w, count(*) AS n FROM (SELECT weight, unnest(['expansion_and', 'regime_dir']) AS facet, unnest([CAST(expansion_and AS VARCHAR), regime_dir]) AS value FROM ov) WHERE value IS NOT NULL AND value <> 'false' GROUP BY 1, 2),
    (SELECT sum(weight) AS tw, count(*) AS tn FROM ov)""", "share_pct base_pct lift")
def _(t):
    w = options.fill_session_weights(undated(t), t.chain)
    return reports.weighted_shares(w, regime_table(t), ["expansion_and"], ["regime_dir"])


@query("weighted_regime_mean", "A17", "SELECT sum(fwd_abs_5 * weight) / sum(CASE WHEN fwd_abs_5 IS NOT NULL THEN weight END) AS weighted_fwd_abs_5, avg(fwd_abs_5) AS mean_fwd_abs_5 FROM reg JOIN cand_dates USING (date)", "weighted_fwd_abs_5 mean_fwd_abs_5")
def _(t):
    w = options.fill_session_weights(undated(t), t.chain).groupBy("date").agg(F.sum("weight").alias("weight"))
    return reports.weighted_mean(regime_table(t).join(w, "date"), "fwd_abs_5", "weight")
