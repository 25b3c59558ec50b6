"""Gap fades, wave fades, backtests, paper trades, journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.numbers import position_size, r_multiple
from barframe.operators import backtest, gaps, sessions, waves
from barframe.plans import q_bars  # noqa: F401  (defines shared expressions)
from barframe.plans.registry import define, query
from barframe.plans.tables import SPLIT

c = F.col

# ---- gaps -----------------------------------------------------------------------------------
define("panel", """SELECT s.ticker, s.date, s.open, s.high, s.low, s.close, s.prev_close, 1e2 * (s.open / s.prev_close - 1e0) AS gap_pct, 1e2 * (s.close / s.open - 1e0) AS stock_oc, 1e2 * (n.close / n.open - 1e0) AS index_oc,
    1e2 * (s.close / s.open - 1e0) - 1e2 * (n.close / n.open - 1e0) AS excess_oc, s.volume / nullif(s.avgvol20, 0) AS vol_ratio, s.t20
    FROM sess s JOIN idx n USING (date) WHERE s.t20 >= 5e7 AND s.open > 0 AND s.prev_close > 0 AND n.open > 0""")
define("base_short", "SELECT count(*) AS n, avg(-excess_oc) AS b FROM panel")


def panel(t):
    return gaps.gap_panel(t.eod, t.index)


@query("gap_panel", "G1 W4", "SELECT * FROM panel", "open high low close prev_close gap_pct stock_oc index_oc excess_oc vol_ratio t20")
def _(t):
    return panel(t)


@query("no_signal_baseline", "G2", "SELECT n, b AS mean_short_excess FROM base_short", "mean_short_excess")
def _(t):
    return gaps.no_signal_baseline(panel(t))


def _fade(name, key, where, side):
    g = "-excess_oc" if side == "short" else "excess_oc"
    m = "-" if side == "short" else "+"
    return f"""SELECT {name}, n, gross AS gross_excess, gross - 2e-1 AS net_excess, gross {m} b AS edge_over_baseline, win_pct FROM (
        SELECT {key} AS {name}, count(*) AS n, avg({g}) AS gross, 1e2 * avg(CASE WHEN {g} > 0 THEN 1e0 ELSE 0e0 END) AS win_pct FROM panel WHERE {where} GROUP BY 1), (SELECT b FROM base_short)"""


_up = "CASE WHEN gap_pct >= 10 THEN 'f: 10%+' WHEN gap_pct >= 7 THEN 'e: 7-10%' WHEN gap_pct >= 5 THEN 'd: 5-7%' WHEN gap_pct >= 3 THEN 'c: 3-5%' WHEN gap_pct >= 2 THEN 'b: 2-3%' ELSE 'a: 1-2%' END"
_down = "CASE WHEN gap_pct <= -10 THEN 'f: -10%+' WHEN gap_pct <= -7 THEN 'e: -7 to -10%' WHEN gap_pct <= -5 THEN 'd: -5 to -7%' WHEN gap_pct <= -3 THEN 'c: -3 to -5%' WHEN gap_pct <= -2 THEN 'b: -2 to -3%' ELSE 'a: -1 to -2%' END"
_vol = "CASE WHEN vol_ratio >= 4 THEN 'vol 4x+' WHEN vol_ratio >= 2 THEN 'vol 2-4x' ELSE 'vol <2x' END"
_period = lambda d: f"CASE WHEN {d} < DATE '{SPLIT}' THEN 'TRAIN' ELSE 'TEST' END"
_f = "gross_excess net_excess edge_over_baseline win_pct"


@query("fade_up_gaps", "G3 P9", _fade("gap_bucket", _up, "gap_pct >= 1", "short"), _f)
def _(t):
    return gaps.up_gap_fade(panel(t))


@query("fade_down_gaps", "G3 P9", _fade("gap_bucket", _down, "gap_pct <= -1", "long"), _f)
def _(t):
    return gaps.down_gap_fade(panel(t))


@query("fade_out_of_sample", "G4 P11", _fade("period", _period("date"), "gap_pct >= 5", "short"), _f)
def _(t):
    return gaps.out_of_sample_fade(panel(t), SPLIT)


@query("fade_volume_climax", "G4 P9", _fade("vol_bucket", _vol, "gap_pct >= 3 AND vol_ratio IS NOT NULL", "short"), _f)
def _(t):
    return gaps.volume_climax_fade(panel(t))


define("signals", """SELECT ticker, date, CASE WHEN open > prev_close THEN 'short' ELSE 'long' END AS direction, open AS entry, close AS exit_close, 1e2 * (open / prev_close - 1e0) AS gap_pct, t20
    FROM sess WHERE prev_close > 0 AND open > 0 AND t20 >= 1e8 AND high > low * 1.001e0 AND abs(1e2 * (open / prev_close - 1e0)) >= 3""")
_rank = "row_number() OVER (PARTITION BY date ORDER BY abs(gap_pct) DESC, ticker)"


def signals(t):
    return gaps.gap_signals(t.eod, 3.0, 1e8)


@query("daily_gap_signals", "G5 O4 P7", f"SELECT * FROM (SELECT *, {_rank} AS pick FROM signals) WHERE pick <= 2", "entry exit_close gap_pct t20")
def _(t):
    return gaps.daily_top_signals(signals(t))


# Intraday paths come from the event stream; its users' days are the instruments.
define("u_sess", """SELECT *, lag(close) OVER w AS prev_close, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS t20 FROM user_days WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
define("u_signals", """SELECT ticker, date, CASE WHEN open > prev_close THEN 'short' ELSE 'long' END AS direction, open AS entry, close AS exit_close, 1e2 * (open / prev_close - 1e0) AS gap_pct, t20
    FROM u_sess WHERE prev_close > 0 AND open > 0 AND t20 >= 1e7 AND high > low * 1.001e0 AND abs(1e2 * (open / prev_close - 1e0)) >= 3""")
define("u_path", "SELECT ticker, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, max(high) AS day_high, min(low) AS day_low FROM intraday GROUP BY 1, 2")
define("stop_base", """SELECT s.*, p.day_high, p.day_low, stop_pct, slip_pct, CASE WHEN direction = 'short' THEN -1e0 ELSE 1e0 END AS side FROM u_signals s JOIN u_path p USING (ticker, date),
    (SELECT unnest([2e0, 3e0, 5e0, 7e0, 1e1]) AS stop_pct), (SELECT unnest([0e0, 3e-1, 6e-1]) AS slip_pct)""")
define("stop_grid", """SELECT *, CASE WHEN (direction = 'short' AND day_high >= trg) OR (direction = 'long' AND day_low <= trg) THEN side * 1e2 * (trg * (1e0 - side * slip_pct / 1e2) / entry - 1e0) - 2e-1 ELSE net_no_stop END AS net FROM (
    SELECT *, entry * (1e0 - side * stop_pct / 1e2) AS trg, side * 1e2 * (exit_close / entry - 1e0) - 2e-1 AS net_no_stop FROM stop_base)""")


def user_signals(t):
    return gaps.gap_signals(t.user_days, 3.0, 1e7)


@query("signals_with_path", "P8", "SELECT * FROM u_signals SEMI JOIN u_path USING (ticker, date)", "entry exit_close gap_pct t20")
def _(t):
    return gaps.with_path(user_signals(t), t.intraday)


@query("hour_sequence", "W15", "SELECT ticker, ts, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, row_number() OVER (PARTITION BY ticker, CAST(ts + INTERVAL 330 MINUTE AS DATE) ORDER BY ts) AS seq FROM intraday")
def _(t):
    return gaps.hour_sequence(t.intraday).select("ticker", "ts", "date", "seq")


@query("stop_grid", "G6 J15", "SELECT ticker, date, direction, stop_pct, slip_pct, net, net_no_stop FROM stop_grid", "stop_pct slip_pct net net_no_stop")
def _(t):
    return gaps.stop_grid(user_signals(t), t.intraday).select("ticker", "date", "direction", "stop_pct", "slip_pct", "net", "net_no_stop")


_pick = lambda p: f"list_sort(list(net))[1 + least(count(*) - 1, CAST(floor({p} * count(*)) AS BIGINT))]"


@query("stop_report", "G6 A18", f"""SELECT stop_pct, slip_pct, count(*) AS n, avg(net) AS mean, min(net) AS worst, 1e2 * avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win_pct,
    1e2 * avg(CASE WHEN abs(net - net_no_stop) > 1e-9 THEN 1e0 ELSE 0e0 END) AS stopped_pct, {_pick('0.01e0')} AS p01, {_pick('0.05e0')} AS p05, {_pick('0.5e0')} AS median FROM stop_grid GROUP BY 1, 2""",
       "stop_pct slip_pct mean worst win_pct stopped_pct p01 p05 median")
def _(t):
    return gaps.stop_report(gaps.stop_grid(user_signals(t), t.intraday))


@query("hourly_fade", "G7 W15", """SELECT seq, count(*) AS n, avg(CASE WHEN direction = 'short' THEN -1e0 ELSE 1e0 END * 1e2 * (close / entry - 1e0)) AS mean_fade FROM u_signals JOIN (
    SELECT ticker, close, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, row_number() OVER (PARTITION BY ticker, CAST(ts + INTERVAL 330 MINUTE AS DATE) ORDER BY ts) AS seq FROM intraday) USING (ticker, date) GROUP BY 1""", "mean_fade")
def _(t):
    return gaps.hourly_fade(user_signals(t), t.intraday)


define("bench_rv", """SELECT date, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w * sqrt(252e0) * 1e2 END AS rv FROM (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS lr FROM idx) WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")


@query("fade_decay", "G7", """SELECT year(date)::BIGINT AS era, CASE WHEN rv < 60 THEN 'low' WHEN rv < 80 THEN 'mid' ELSE 'high' END AS vol_regime, count(*) AS n,
    avg(CASE WHEN gap_pct > 0 THEN -1e0 ELSE 1e0 END * excess_oc - 2e-1) AS mean_net FROM panel JOIN bench_rv USING (date) WHERE abs(gap_pct) >= 3 AND rv IS NOT NULL GROUP BY 1, 2""", "mean_net")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("index_name").orderBy("date")
    b = t.index.withColumn("lr", F.log(c("close") / F.lag("close").over(w)))
    b = b.select("date", (sessions.rolling_std("lr", -19, 0, "index_name", "date") * F.sqrt(F.lit(252.0)) * 100.0).alias("rv20_hist"))
    return gaps.decay_table(panel(t), b, (60.0, 80.0))


# ---- waves ----------------------------------------------------------------------------------
define("w_lab", """SELECT *, CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN high > lag(high) OVER w AND low > lag(low) OVER w THEN 'up' WHEN high < lag(high) OVER w AND low < lag(low) OVER w THEN 'down' ELSE 'none' END AS dir,
    lag(open) OVER w AS po, lag(close, 2) OVER w AS ppc, count(*) OVER (PARTITION BY ticker) AS bars FROM sess WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
define("w_isle", "SELECT *, sn - row_number() OVER (PARTITION BY ticker, dir ORDER BY date) AS isle FROM w_lab WHERE bars >= 60")
define("w_runs", """SELECT ticker, dir, isle, count(*) AS len, max(sn) AS last_sn, arg_min(open, sn) AS fo, arg_min(prev_close, sn) AS bc, arg_min(po, sn) AS bo, first(ppc ORDER BY sn) AS bbc, arg_max(close, sn) AS lc
    FROM w_isle WHERE dir IN ('up', 'down') GROUP BY 1, 2, 3""")
define("w_sig", """SELECT b.ticker, b.date AS signal_date, CASE r.dir WHEN 'up' THEN 'short' ELSE 'long' END AS direction, r.dir AS wave_dir, r.len AS wave_len, (lc - fo) / fo * 1e2 AS wave_move_pct, abs(b.close - b.open) / (b.high - b.low) AS body_ratio,
    (b.high - b.low) / b.open * 1e2 AS range_pct, (fo - bc) / bc * 1e2 AS start_gap_pct, (bo - bbc) / bbc * 1e2 AS prior_gap_pct FROM w_runs r JOIN w_isle b ON b.ticker = r.ticker AND b.sn = r.last_sn + 1
    WHERE b.dir = 'none' AND r.len >= 2 AND b.high > b.low AND b.open > 0""")


def wave(t):
    return waves.wave_signals(t.eod, min_len=2)


@query("wave_signals", "V1", "SELECT * FROM w_sig", "wave_move_pct body_ratio range_pct start_gap_pct prior_gap_pct")
def _(t):
    return wave(t)


@query("wave_distribution", "V2 A3", "SELECT wave_dir, count(*) AS n, avg(wave_len) AS avg_len, avg(wave_move_pct) AS avg_move_pct, avg(body_ratio) AS avg_body_ratio, count(*) FILTER (WHERE body_ratio < 3e-1) AS body_lt_030 FROM w_sig GROUP BY 1", "avg_len avg_move_pct avg_body_ratio")
def _(t):
    return waves.wave_distribution(wave(t))


_open_exc = lambda h: q_bars._exc(h, "open", "open")
define("fades", f"""SELECT w.*, s.volume / nullif(s.avgvol20, 0) AS signal_vol_ratio, e.t20, e.date AS entry_date, e.open AS entry_open, {', '.join(f'{_open_exc(h)} AS exc_{h}' for h in (1, 3, 5, 10))}
    FROM w_sig w JOIN sess s ON s.ticker = w.ticker AND s.date = w.signal_date JOIN fwd e ON e.ticker = w.ticker AND e.sn = s.sn + 1 JOIN bfwd n ON n.date = e.date WHERE e.t20 >= 5e7 AND e.open > 0 AND n.open > 0""")


def fades(t):
    return waves.price_fades(wave(t), t.eod, t.index)


@query("fade_outcomes", "V3 J6", "SELECT * FROM fades", "wave_move_pct body_ratio range_pct start_gap_pct prior_gap_pct signal_vol_ratio t20 entry_open exc_1 exc_3 exc_5 exc_10")
def _(t):
    return fades(t)


@query("random_control", "V4 J15", f"""SELECT ticker, pick_date, direction, {_open_exc(5)} AS exc_5 FROM (
    SELECT s.ticker, s.date AS pick_date, s.sn, unnest(['long', 'short']) AS direction FROM sess s WHERE s.t20 >= 5e7 AND substr(md5(s.ticker || '|' || CAST(s.date AS VARCHAR)), 1, 4) < '{65536 // 10:04x}') p
    JOIN fwd e USING (ticker) JOIN bfwd n ON n.date = e.date WHERE e.sn = p.sn + 1 AND e.t20 IS NOT NULL AND e.open > 0 AND n.open > 0""", "exc_5")
def _(t):
    return waves.random_control(t.eod, t.index, share=10)


_q5 = "count(*) AS n, avg(exc_5) AS mean, 1e2 * avg(CASE WHEN exc_5 > 0 THEN 1e0 ELSE 0e0 END) AS win_pct"


@query("wave_threshold_sweep", "V5", f"SELECT threshold, wave_dir, {_q5}, avg(exc_10) AS mean_10, quantile_cont(exc_5, 0.5) AS median FROM fades, (SELECT unnest([0.15e0, 0.2e0, 0.25e0, 0.3e0, 0.4e0, 0.5e0]) AS threshold) WHERE body_ratio < threshold AND exc_5 IS NOT NULL GROUP BY 1, 2", "threshold mean win_pct mean_10 median")
def _(t):
    return waves.threshold_sweep(fades(t))


@query("wave_gap_context", "V6", f"SELECT wave_dir, {_q5}, avg(exc_10) AS mean_10, quantile_cont(exc_5, 0.5) AS median FROM fades WHERE exc_5 IS NOT NULL AND body_ratio < 3e-1 AND ((wave_dir = 'up' AND start_gap_pct >= 4) OR (wave_dir = 'down' AND start_gap_pct <= -4)) GROUP BY 1", "mean win_pct mean_10 median")
def _(t):
    return waves.gap_context(fades(t))


@query("wave_out_of_sample", "V6 A2", f"SELECT {_period('entry_date')} AS period, wave_dir, {_q5} FROM fades WHERE exc_5 IS NOT NULL AND body_ratio < 3e-1 GROUP BY 1, 2", "mean win_pct")
def _(t):
    return waves.out_of_sample(fades(t), SPLIT)


_cuts = {
    "length": "CAST(least(wave_len, 6) AS VARCHAR)",
    "extension": "CASE WHEN abs(wave_move_pct) < 5 THEN 'a: <5%' WHEN abs(wave_move_pct) < 10 THEN 'b: 5-10%' WHEN abs(wave_move_pct) < 15 THEN 'c: 10-15%' ELSE 'd: 15%+' END",
    "volume": "CASE WHEN signal_vol_ratio IS NULL THEN NULL WHEN signal_vol_ratio < 0.8e0 THEN 'a: quiet' WHEN signal_vol_ratio < 1.2e0 THEN 'b: normal' WHEN signal_vol_ratio < 2 THEN 'c: elevated' WHEN signal_vol_ratio < 3 THEN 'd: high' ELSE 'e: climax' END",
    "liquidity": "CASE WHEN t20 >= 1e9 THEN 'liquid' WHEN t20 >= 2.5e8 THEN 'mid' ELSE 'thin' END",
}
for _name, _key in _cuts.items():
    query(f"wave_cut_{_name}", "V7", f"SELECT wave_dir, {_key} AS cut, {_q5}, quantile_cont(exc_5, 0.5) AS median FROM fades WHERE exc_5 IS NOT NULL GROUP BY 1, 2", "mean win_pct median")(
        lambda t, n=_name: waves.cut_by(fades(t), n)
    )

# ---- backtest ---------------------------------------------------------------------------------
define("bt_sig", "SELECT ticker, date, CASE WHEN gap_pct > 0 THEN 'short' ELSE 'long' END AS direction, gap_pct, excess_oc * 2e-2 AS excess_oc FROM panel WHERE abs(gap_pct) >= 3 AND t20 >= 1e8 AND high > low * 1.001e0")
define("bt_day", f"""SELECT strategy, date, sum(net) / strategy AS day_pct, count(*) AS n, count(*) FILTER (WHERE net > 0) AS wins FROM (
    SELECT *, CASE direction WHEN 'short' THEN -excess_oc ELSE excess_oc END - 2e-1 AS net, {_rank} AS rk FROM bt_sig), (SELECT unnest([1, 2, 5])::BIGINT AS strategy) WHERE rk <= strategy GROUP BY 1, 2""")
define("bt_curve", """SELECT *, (peak - equity) / peak * 1e2 AS drawdown_pct FROM (SELECT *, greatest(1e2, max(equity) OVER (PARTITION BY strategy ORDER BY date)) AS peak FROM (
    SELECT *, 1e2 * exp(sum(ln(1e0 + day_pct / 1e2)) OVER (PARTITION BY strategy ORDER BY date)) AS equity FROM bt_day))""")


def daily(t):
    s = panel(t).where((F.abs("gap_pct") >= 3.0) & (c("t20") >= 1e8) & gaps.not_locked())
    s = s.withColumn("direction", F.when(c("gap_pct") > 0, "short").otherwise("long"))
    s = s.withColumn("excess_oc", c("excess_oc") * 0.02)  # weekly noise of the stand-in to a daily size
    return backtest.daily_results(s, (1, 2, 5))


@query("backtest_days", "B1 O4", "SELECT * FROM bt_day", "day_pct")
def _(t):
    return daily(t)


@query("equity_curve", "B1 W17", "SELECT * FROM bt_curve", "day_pct equity peak drawdown_pct", digits=3)
def _(t):
    return backtest.equity_curve(daily(t))


@query("backtest_summary", "B1", """SELECT strategy, days, trades, win_rate, mean_day, equity, max_drawdown, years, (pow(equity / 1e2, 1e0 / years) - 1e0) * 1e2 AS cagr, mean_day / sd * sqrt(252e0) AS sharpe FROM (
    SELECT strategy, count(*) AS days, sum(n)::BIGINT AS trades, 1e2 * sum(wins) / sum(n) AS win_rate, avg(day_pct) AS mean_day, arg_max(equity, date) AS equity, max(drawdown_pct) AS max_drawdown, (max(date) - min(date)) / 365.25e0 AS years, stddev_pop(day_pct) AS sd FROM bt_curve GROUP BY 1)""",
       "win_rate mean_day equity max_drawdown years cagr sharpe")
def _(t):
    return backtest.backtest_summary(backtest.equity_curve(daily(t)))


@query("backtest_years", "B2", "SELECT strategy, year(date)::BIGINT AS year, count(*) AS days, sum(n)::BIGINT AS trades, sum(day_pct) AS sum_pct FROM bt_day GROUP BY 1, 2", "sum_pct")
def _(t):
    return backtest.yearly_sums(daily(t))


@query("worst_days", "B2 O7", "SELECT * FROM bt_day ORDER BY day_pct, date, strategy LIMIT 5", "day_pct")
def _(t):
    return backtest.worst_days(daily(t))


@query("stress_months", "B6", """SELECT CASE WHEN k < 40 THEN 'a: calm' WHEN k < 60 THEN 'b: normal' WHEN k < 90 THEN 'c: busy' ELSE 'd: stress' END AS month_type, count(*) AS months, avg(m) AS avg_gross, avg(w) AS avg_win_pct, min(m) AS worst_month FROM (
    SELECT date_trunc('month', date) AS mo, count(*) AS k, avg(g) AS m, 1e2 * avg(CASE WHEN g > 0 THEN 1e0 ELSE 0e0 END) AS w FROM (SELECT date, CASE WHEN gap_pct > 0 THEN -excess_oc ELSE excess_oc END AS g FROM panel WHERE abs(gap_pct) >= 3) GROUP BY 1) GROUP BY 1""", "avg_gross avg_win_pct worst_month")
def _(t):
    return backtest.stress_months(panel(t), cuts=(40, 60, 90))


# ---- paper trades and journal ---------------------------------------------------------------------
define("paper", f"""SELECT s.date AS trade_date, s.ticker, direction, gap_pct, t20 / 1e7 AS turnover_cr, entry AS assumed_open, actual_fill,
    1e2 * CASE direction WHEN 'short' THEN entry - actual_fill ELSE actual_fill - entry END / entry AS slippage_pct FROM (SELECT *, {_rank} AS pick FROM signals) s
    LEFT JOIN (SELECT date, ticker, open * (1e0 + (volume % 7) * 1e-3) AS actual_fill FROM eod WHERE volume % 3 <> 0) f ON f.date = s.date AND f.ticker = s.ticker WHERE pick <= 2""")
define("settled", """SELECT p.*, e.close AS exit_price, side * 1e2 * (e.close / coalesce(actual_fill, assumed_open) - 1e0) AS gross_pct, side * 1e2 * (e.close / coalesce(actual_fill, assumed_open) - 1e0) - 2e-1 AS net_pct,
    CASE WHEN e.close IS NULL THEN 'open' ELSE 'closed' END AS status FROM (SELECT *, CASE direction WHEN 'short' THEN -1e0 ELSE 1e0 END AS side FROM paper) p LEFT JOIN (SELECT * FROM eod WHERE volume % 11 <> 0) e ON e.ticker = p.ticker AND e.date = p.trade_date""")


def paper(t):
    trades = backtest.paper_log(gaps.daily_top_signals(signals(t)))
    fills = t.eod.where(c("volume") % 3 != 0).select(c("date").alias("trade_date"), "ticker", (c("open") * (F.lit(1.0) + (c("volume") % 7) * 0.001)).alias("actual_fill"))
    return backtest.settle(backtest.apply_fills(trades, fills), t.eod.where(c("volume") % 11 != 0))


_pcols = "gap_pct turnover_cr assumed_open actual_fill slippage_pct exit_price gross_pct net_pct"


@query("paper_trades", "B3", "SELECT * EXCLUDE (side) FROM settled", _pcols)
def _(t):
    return paper(t)


_rep = "count(*) AS n, count(*) FILTER (WHERE status = 'closed') AS closed, avg(net_pct) AS mean_net, 1e2 * avg(CASE WHEN net_pct > 0 THEN 1e0 ELSE 0e0 END) AS win_pct, min(net_pct) AS worst, avg(slippage_pct) AS mean_slippage"


@query("paper_report", "B4 A3", f"SELECT {_rep} FROM settled", "mean_net win_pct worst mean_slippage")
def _(t):
    return backtest.paper_report(paper(t))


@query("strategy_guard", "B7", f"""SELECT *, closed >= 50 AND (slippage_breach OR win_breach OR loss_breach) AS halt FROM (SELECT *, coalesce(mean_slippage > 0.15e0, FALSE) AS slippage_breach, coalesce(win_pct < 48, FALSE) AS win_breach, coalesce(worst < -20, FALSE) AS loss_breach
    FROM (SELECT direction, {_rep} FROM settled GROUP BY 1))""", "mean_net win_pct worst mean_slippage")
def _(t):
    return backtest.strategy_guard(paper(t), ["direction"])


define("journal_in", """SELECT (date - DATE '1970-01-01')::BIGINT * 100000000 + CAST(translate(substr(ticker, 3), 'ABCDEFGHIJ', '0123456789') AS BIGINT) AS id, ticker, direction, entry, entry * CASE direction WHEN 'long' THEN 0.95e0 ELSE 1.05e0 END AS stop, exit_close, date::TIMESTAMP AS opened_at, date::TIMESTAMP + INTERVAL 10 HOUR AS x_at, CAST(floor(t20 / 1e6) AS BIGINT) % 4 <> 0 AS has_exit FROM signals""")
define("journal_t", """SELECT id, ticker, direction, entry, stop, opened_at, CASE WHEN has_exit THEN exit_close END AS exit_price, CASE WHEN has_exit THEN x_at END AS closed_at,
    CASE WHEN has_exit THEN round(CASE direction WHEN 'long' THEN exit_close - entry ELSE entry - exit_close END / abs(entry - stop), 2) END AS r_multiple FROM journal_in""")


def journal(t):
    s = signals(t)
    number = F.translate(F.substring("ticker", 3, 10), "ABCDEFGHIJ", "0123456789").cast("long")
    ids = s.withColumn("id", F.unix_date("date").cast("long") * 100_000_000 + number)
    at = c("date").cast("timestamp")
    rows = ids.select(
        "id", "ticker", "direction", "entry", (c("entry") * F.when(c("direction") == "long", 0.95).otherwise(1.05)).alias("stop"), at.alias("opened_at"),
        F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("double").alias("r_multiple"))
    exits = ids.where(F.floor(c("t20") / 1e6) % 4 != 0).select("id", c("exit_close").alias("exit_price"), F.timestamp_seconds(F.unix_seconds(at) + 36000).alias("closed_at"))
    return backtest.close_trades(rows, exits)


@query("journal_close", "B5 X25", "SELECT * FROM journal_t", "entry stop exit_price r_multiple", digits=2)
def _(t):
    return journal(t)


@query("journal_list", "B5 O5", "SELECT id, ticker, direction, opened_at, closed_at FROM journal_t ORDER BY closed_at IS NULL DESC, opened_at DESC, id LIMIT 100")
def _(t):
    return backtest.journal(journal(t)).select("id", "ticker", "direction", "opened_at", "closed_at")


@query("journal_stats", "B5 A21", """SELECT direction, count(*) AS n, count(*) FILTER (WHERE closed_at IS NULL) AS open_count, count(closed_at) AS closed_count, round(avg(r_multiple) FILTER (WHERE closed_at IS NOT NULL), 2) AS avg_r,
    round(avg(CASE WHEN r_multiple > 0 THEN 1e2 ELSE 0e0 END) FILTER (WHERE closed_at IS NOT NULL), 1) AS win_rate FROM journal_t GROUP BY 1""", "avg_r win_rate", digits=2)
def _(t):
    return backtest.journal_stats(journal(t), ["direction"])


@query("position_size", "X26 X25", """SELECT ticker, date, direction, CASE WHEN entry > stop OR entry < stop THEN CAST(floor(5e5 * 1e-2 / abs(entry - stop)) AS BIGINT) ELSE 0 END AS qty, CAST(floor(5e5 * 1e-2 / abs(entry - stop)) AS BIGINT) * entry AS position_value, round((CASE direction WHEN 'long' THEN exit_close - entry ELSE entry - exit_close END) / abs(entry - stop), 2) AS r
    FROM (SELECT *, entry * CASE direction WHEN 'long' THEN 0.97e0 ELSE 1.03e0 END AS stop FROM signals)""", "position_value r", digits=2)
def _(t):
    s = signals(t).withColumn("stop", c("entry") * F.when(c("direction") == "long", 0.97).otherwise(1.03))
    qty = position_size(F.lit(500000.0), F.lit(1.0), c("entry"), c("stop"))
    return s.select("ticker", "date", "direction", qty.alias("qty"), (qty * c("entry")).alias("position_value"), r_multiple(c("direction"), c("entry"), c("stop"), c("exit_close")).alias("r"))
