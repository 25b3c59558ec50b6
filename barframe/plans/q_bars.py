"""Bars: windows, indicators, screener."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barframe.operators import feed, indicators, order_values, reports, screener, sessions
from barframe.plans import order_value_sql
from barframe.plans.registry import define, query
from barframe.plans.tables import AS_OF, SINCE, SPLIT
from barframe.session import scratch_path
from barframe.sources.sinks import replace_partitions

c = F.col
W = "PARTITION BY ticker ORDER BY date"

# ---- windows --------------------------------------------------------------------------------


@query("bars_from_trades", "F1 bars, U4", "SELECT * FROM eod", "open high low close close_raw")
def _(t):
    return t.fresh_eod


@query("session_ordinal", "W1 L5", f"SELECT ticker, date, row_number() OVER ({W})::BIGINT AS sn FROM eod")
def _(t):
    return sessions.with_session_number(t.eod).select("ticker", "date", "sn")


@query("trailing_turnover", "W2 P5 L5", "SELECT ticker, date, t20 FROM sess WHERE t20 >= 5e7", "t20")
def _(t):
    return sessions.with_turnover(t.eod).where(c("t20") >= 5e7).select("ticker", "date", "t20")


@query("volume_ratio", "W2 L5", "SELECT ticker, date, avgvol20, volume / nullif(avgvol20, 0) AS vol_ratio FROM sess", "avgvol20 vol_ratio")
def _(t):
    return sessions.with_volume_ratio(t.eod).select("ticker", "date", "avgvol20", "vol_ratio")


@query("benchmark_regime", "W3 L5", "SELECT date, nsn, sma50, CASE WHEN close >= sma50 THEN 'up' ELSE 'down' END AS regime FROM bench", "sma50")
def _(t):
    b = sessions.benchmark_series(t.index)
    return b.select("date", "nsn", "sma50", F.when(c("close") >= c("sma50"), "up").otherwise("down").alias("regime"))


@query("previous_close_gap", "W4 W18", """SELECT ticker, date, 1e2 * (open / prev_close - 1e0) AS overnight_pct, 1e2 * (close / open - 1e0) AS intraday_pct
    FROM sess WHERE prev_close > 0 AND open > 0""", "overnight_pct intraday_pct")
def _(t):
    from barframe.operators.gaps import day_parts

    return day_parts(t.eod)


@query("forward_offset_returns", "J6 W13", f"SELECT ticker, date, " + ", ".join(
    f"1e2 * (lead(close, {h}) OVER ({W}) / close - 1e0) AS ret_{h}" for h in (1, 3, 5, 10)) + " FROM eod", "ret_1 ret_3 ret_5 ret_10")
def _(t):
    b = sessions.with_forward_close(t.eod, (1, 3, 5, 10))
    return b.select("ticker", "date", *[(F.lit(100.0) * (c(f"fwd_close_{h}") / c("close") - 1.0)).alias(f"ret_{h}") for h in (1, 3, 5, 10)])


_streaks = """SELECT ticker, date, (row_number() OVER (PARTITION BY ticker, isle ORDER BY date) - 1)::BIGINT AS up_streak FROM (
    SELECT ticker, date, sum(CASE WHEN rise THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS isle FROM (
    SELECT ticker, date, coalesce(close > lag(close) OVER (PARTITION BY ticker ORDER BY date), FALSE) AS rise FROM eod))"""


@query("up_streak", "W10", _streaks)
def _(t):
    return sessions.up_streak(t.eod, "close", "ticker", "date", "up_streak").select("ticker", "date", "up_streak")


def _roll(n, lo=None):
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1 if lo is None else lo} PRECEDING AND CURRENT ROW)"


@query("rolling_rank", "W7", f"""SELECT ticker, date,
    CASE WHEN count(close) OVER {_roll(20)} = 20 THEN (close - min(close) OVER {_roll(20)}) / nullif(max(close) OVER {_roll(20)} - min(close) OVER {_roll(20)}, 0) END AS rank_20,
    CASE WHEN count(close) OVER {_roll(60)} = 60 THEN (close - min(close) OVER {_roll(60)}) / nullif(max(close) OVER {_roll(60)} - min(close) OVER {_roll(60)}, 0) END AS rank_60
    FROM eod""", "rank_20 rank_60")
def _(t):
    rank = lambda n: sessions.rolling_rank(t.eod, "close", n, "ticker", "date").alias(f"rank_{n}")
    return t.eod.select("ticker", "date", rank(20), rank(60))


@query("rolling_percentile", "W8", """SELECT ticker, date, CASE WHEN len(b) = 251 THEN 1e2 * len(list_filter(b, lambda x: x <= close)) / 251e0 END AS pctile
    FROM (SELECT ticker, date, close, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING) AS b FROM eod)""", "pctile")
def _(t):
    return t.eod.select("ticker", "date", sessions.rolling_percentile("close", 252, "ticker", "date").alias("pctile"))


@query("rolling_mean_and_volatility", "W9 W11 W12", f"""SELECT ticker, date,
    CASE WHEN count(close) OVER {_roll(5)} = 5 THEN avg(close) OVER {_roll(5)} END AS ma5,
    close - lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS delta5,
    CASE WHEN count(lr) OVER {_roll(20)} = 20 THEN stddev_samp(lr) OVER {_roll(20)} * sqrt(252e0) * 1e2 END AS rv_past,
    CASE WHEN count(lr) OVER n = 20 THEN stddev_samp(lr) OVER n * sqrt(252e0) * 1e2 END AS rv_next
    FROM (SELECT *, ln(close / prev_close) AS lr FROM sess) WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""", "ma5 delta5 rv_past rv_next")
def _(t):
    k = ("ticker", "date")
    b = sessions.with_previous_close(t.eod).withColumn("lr", F.log(c("close") / c("prev_close")))
    ann = F.sqrt(F.lit(252.0)) * 100.0
    return b.select(
        "ticker", "date", sessions.rolling_mean("close", 5, *k).alias("ma5"),
        (c("close") - F.lag("close", 5).over(sessions.by_ticker())).alias("delta5"),
        (sessions.rolling_std("lr", -19, 0, *k) * ann).alias("rv_past"), (sessions.rolling_std("lr", 1, 20, *k) * ann).alias("rv_next"),
    )


# ---- indicators -----------------------------------------------------------------------------
# The SQL side folds the recursions step by step over prefix lists, an independent formulation.


def _fold(values: str, p: int, keep: str, add: str) -> str:
    return f"CASE WHEN len({values}) >= {p} THEN list_reduce({values}[{p + 1}:], lambda e, x: e * {keep} + x * {add}, list_avg({values}[1:{p}])) END"


def _ema(p: int) -> str:
    return _fold("cs", p, f"(1e0 - 2e0 / {p + 1})", f"(2e0 / {p + 1})")


def _wilder(values: str, p: int) -> str:
    return _fold(values, p, f"({p - 1}e0 / {p})", f"(1e0 / {p})")


def _rsi(p: int) -> str:
    return f"CASE WHEN gain{p} IS NULL THEN NULL WHEN loss{p} = 0 THEN CASE WHEN gain{p} = 0 THEN 5e1 ELSE 1e2 END ELSE 1e2 - 1e2 / (1e0 + gain{p} / loss{p}) END"


define("ind_lists", f"""SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY ticker) AS bars, list(close) OVER w AS cs,
    list(greatest(close - prev_close, 0e0)) FILTER (WHERE prev_close IS NOT NULL) OVER w AS gs,
    list(greatest(prev_close - close, 0e0)) FILTER (WHERE prev_close IS NOT NULL) OVER w AS ls,
    list(greatest(high - low, abs(high - prev_close), abs(low - prev_close))) FILTER (WHERE prev_close IS NOT NULL) OVER w AS trs,
    CASE WHEN count(*) OVER k7 = 7 THEN CASE WHEN max(high) OVER k7 > min(low) OVER k7 THEN (close - min(low) OVER k7) / (max(high) OVER k7 - min(low) OVER k7) * 1e2 ELSE 5e1 END END AS raw_k
    FROM sess WINDOW w AS (PARTITION BY ticker ORDER BY date), k7 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
define("ind_values", f"""SELECT ticker, date, open, high, low, close, close_raw, volume, n, bars, prev_close AS close_prev,
    {_ema(20)} AS ema20, {_ema(50)} AS ema50, {_ema(200)} AS ema200,
    {_wilder('gs', 7)} AS gain7, {_wilder('ls', 7)} AS loss7, {_wilder('gs', 14)} AS gain14, {_wilder('ls', 14)} AS loss14, {_wilder('trs', 14)} AS atr14,
    CASE WHEN count(*) OVER d20 = 20 THEN avg(close) OVER d20 END AS sma20, CASE WHEN count(*) OVER d20 = 20 THEN avg(volume) OVER d20 END AS avg_vol20,
    CASE WHEN count(raw_k) OVER d10 = 10 THEN avg(raw_k) OVER d10 END AS stoch_k,
    CASE WHEN lag(close, 20) OVER w > 0 THEN (close - lag(close, 20) OVER w) / lag(close, 20) OVER w * 1e2 END AS roc20,
    (close - max(high) OVER y) / max(high) OVER y * 1e2 AS pct_from_52w_high
    FROM ind_lists WINDOW w AS (PARTITION BY ticker ORDER BY date), d20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    d10 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), y AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
define("ind_all", f"""SELECT *, {_rsi(7)} AS rsi7, {_rsi(14)} AS rsi14,
    CASE WHEN (ema20 - ema50) / ema50 * 1e2 > 1e-1 THEN 'UP' WHEN (ema20 - ema50) / ema50 * 1e2 < -1e-1 THEN 'DOWN' WHEN ema50 IS NOT NULL THEN 'FLAT' END AS weekly_trend
    FROM ind_values""")
define("ind", """SELECT *, lag(sma20) OVER w AS sma20_prev, lag(rsi7) OVER w AS rsi7_prev, lag(stoch_k) OVER w AS stoch_k_prev
    FROM ind_all WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
define("hist", "SELECT * FROM ind WHERE bars >= 60 AND n >= 2")
NUM = [x for x in indicators.INDICATORS if x != "weekly_trend"]
ALL = ", ".join(indicators.INDICATORS)


@query("indicator_history", "I1 I2 I3 I4 I5 I6 I7 I8 I9 I11 A10", f"SELECT ticker, date, {ALL} FROM hist", " ".join(NUM))
def _(t):
    return indicators.indicator_history(t.eod).select("ticker", "date", *indicators.INDICATORS)


@query("indicator_snapshot", "I10 I12 O6", f"""SELECT ticker, date, close, volume, {', '.join(x for x in NUM if x != 'stoch_k')},
    CASE WHEN bars >= 17 THEN stoch_k END AS stoch_k, coalesce(weekly_trend, 'FLAT') AS weekly_trend
    FROM ind WHERE date = (SELECT max(date) FROM eod)""", "close " + " ".join(NUM))
def _(t):
    return indicators.latest_snapshot(t.eod)


# ---- screener -------------------------------------------------------------------------------
_dma = {"long": "weekly_trend = 'UP' AND close_prev < sma20_prev AND close > sma20", "short": "weekly_trend = 'DOWN' AND close_prev > sma20_prev AND close < sma20"}
_rsi7 = {"long": "weekly_trend = 'UP' AND rsi7_prev < 40 AND rsi7 > rsi7_prev", "short": "weekly_trend = 'DOWN' AND rsi7_prev > 60 AND rsi7 < rsi7_prev"}
_sto = {"long": "weekly_trend = 'UP' AND stoch_k_prev < 20 AND stoch_k > stoch_k_prev", "short": "weekly_trend = 'DOWN' AND stoch_k_prev > 80 AND stoch_k < stoch_k_prev"}
_con = {d: f"{_dma[d]} AND {_rsi7[d]} AND {_sto[d]}" for d in _dma}
_rules = {"dma-pullback": _dma, "rsi-reaction": _rsi7, "stoch-reaction": _sto, "confluence": _con}
define("ranked", """SELECT *, row_number() OVER (PARTITION BY date ORDER BY roc20 DESC, ticker) AS rn FROM hist
    WHERE close_raw > 200 AND volume > 100000 AND roc20 IS NOT NULL""")


def _hits(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT ticker, date, '{n}' AS setup, '{d}' AS direction, '{n}-{d}@v1' AS setup_name, roc20 FROM {source} WHERE {cond}"
        for n, rule in _rules.items() for d, cond in rule.items()
    )


define("replay", _hits("(SELECT * FROM ranked WHERE rn <= 15)"))
define("day_universe", "SELECT * FROM ranked WHERE date = DATE '2000-06-05' AND rn <= 15")
define("day_hits", _hits("day_universe"))


@query("screener_universe", "Q1 J1 O2", "SELECT ticker, date, close, volume, roc20 FROM day_universe", "close roc20")
def _(t):
    h = indicators.indicator_history(t.eod)
    return screener.universe(h, t.eod, "2000-06-05", 15).select("ticker", "date", "close", "volume", "roc20")


@query("screener_setups", "Q2 Q3 Q4 Q5 Q6 U1 X20", "SELECT ticker, date, setup, direction, setup_name, roc20, n FROM (SELECT *, CASE setup WHEN 'dma-pullback' THEN 6 WHEN 'confluence' THEN 10 ELSE 5 END::BIGINT AS n FROM replay)", "roc20")
def _(t):
    h = indicators.indicator_history(t.eod)
    hits = screener.run_setups(screener.ranked_universe(h, 15))
    return hits.withColumn("n", F.size("screen_values").cast("long")).drop("screen_values")


@query("screener_replay", "Q9 W6 U1", "SELECT ticker, date, setup, direction, roc20 FROM replay", "roc20")
def _(t):
    return screener.replay(indicators.indicator_history(t.eod), 15)


@query("setup_counts", "A22", "SELECT setup_name, count(*) AS n FROM replay GROUP BY 1")
def _(t):
    h = indicators.indicator_history(t.eod)
    return screener.setup_counts(screener.run_setups(screener.ranked_universe(h, 15)))


define("catalyst_events", f"""SELECT symbol AS ticker, seq_id AS id, attachment_text AS title, announced_at AS published_at,
    CAST((filing_no * 31) % 100 AS DOUBLE) / 1e1 AS impact_score FROM filings""")
define("best_catalyst", """SELECT * FROM catalyst_events WHERE impact_score >= 6 AND published_at BETWEEN TIMESTAMP '2000-06-05' - INTERVAL 5 DAY AND TIMESTAMP '2000-06-05' 
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY impact_score DESC, published_at DESC, id DESC) = 1""")


def _catalyst_events(t):
    return t.filings.select(
        c("symbol").alias("ticker"), c("seq_id").alias("id"), c("attachment_text").alias("title"), c("announced_at").alias("published_at"),
        ((c("filing_no") * 31) % 100 / 10.0).alias("impact_score"),
    )


@query("screener_nightly", "Q7 Q8 J10 O3", """SELECT h.ticker, h.date, h.setup_name, h.roc20, b.id AS catalyst_event_id, b.title AS catalyst_title, b.impact_score AS catalyst_score
    FROM day_hits h LEFT JOIN best_catalyst b USING (ticker)""", "roc20 catalyst_score")
def _(t):
    h = indicators.indicator_history(t.eod)
    path = scratch_path(t.spark, "candidates")
    for _ in range(2):  # the job run twice for one date leaves one run's rows
        out = screener.nightly(h, t.eod, _catalyst_events(t), "2000-06-05 00:00:00", "2000-06-05", 15)
        replace_partitions(out.select("ticker", "date", "setup_name", "roc20", "catalyst_event_id", "catalyst_title", "catalyst_score"), path, ["date"])
    return t.spark.read.schema("ticker string, setup_name string, roc20 double, catalyst_event_id string, catalyst_title string, catalyst_score double, date date").parquet(path)


@query("candidate_list", "P3 P4 J3 J2", """SELECT h.ticker, h.date, h.setup_name, b.id AS catalyst_event_id, e.title AS catalyst_title, e.impact_score AS catalyst_score,
    k.name AS company_name, k.sector, k.market_cap_category, h.setup AS setup_base
    FROM day_hits h LEFT JOIN best_catalyst b USING (ticker) LEFT JOIN companies k USING (ticker) LEFT JOIN catalyst_events e ON e.id = b.id
    WHERE h.direction = 'long'""", "catalyst_score")
def _(t):
    from barframe.functions.filings import setup_base

    h = indicators.indicator_history(t.eod)
    ev = _catalyst_events(t)
    cands = screener.nightly(h, t.eod, ev, "2000-06-05 00:00:00", "2000-06-05", 15)
    out = feed.candidate_list(cands, t.companies, ev, "2000-06-05", direction="long")
    return out.select("ticker", "date", "setup_name", "catalyst_event_id", "catalyst_title", "catalyst_score", "company_name", "sector", "market_cap_category", setup_base("setup_name").alias("setup_base"))


define("fwd", f"SELECT *, " + ", ".join(f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) AS f{h}" for h in (1, 3, 5, 10, 20)) + " FROM sess")
define("bfwd", "SELECT *, " + ", ".join(f"lead(close, {h}) OVER (ORDER BY date) AS n{h}" for h in (1, 3, 5, 10, 20)) + " FROM bench")
_exc = lambda h, px="close", nx="close": f"(CASE WHEN direction = 'long' THEN 1e0 ELSE -1e0 END * (1e2 * (e.f{h} / e.{px} - 1e0) - 1e2 * (n.n{h} / n.{nx} - 1e0)) - 0.35e0)"
define("candidate_outcomes", f"""SELECT r.ticker, r.date AS signal_date, r.setup, r.direction, e.sn AS entry_sn, e.date AS entry_date, e.close AS entry_close,
    {_exc(5)} AS exc_5, {_exc(10)} AS exc_10 FROM replay r JOIN sess s ON s.ticker = r.ticker AND s.date = r.date
    JOIN fwd e ON e.ticker = r.ticker AND e.sn = s.sn + 1 JOIN bfwd n ON n.date = e.date WHERE e.t20 >= 5e7 AND e.close > 0""")


def _outcomes(t):
    cands = screener.replay(indicators.indicator_history(t.eod), 15)
    return screener.price_candidates(cands, t.eod, t.index)


@query("candidate_outcomes", "Q10 J6 J12", "SELECT * FROM candidate_outcomes", "entry_close exc_5 exc_10")
def _(t):
    return _outcomes(t)


define("typed", f"""SELECT seq_id, symbol, category, announced_at,
    CASE WHEN strftime(announced_at + INTERVAL 330 MINUTE, '%H:%M') < '09:15' THEN CAST(announced_at + INTERVAL 330 MINUTE AS DATE) - 1 ELSE CAST(announced_at + INTERVAL 330 MINUTE AS DATE) END AS tradeable_after,
    CASE WHEN regexp_matches(attachment_text, '(?is)(emerges|declared).{{0,25}}(l-?1|lowest bidder)') THEN 'l1-bid'
         WHEN regexp_matches(attachment_text, '(?is)letter of (intent|award)|\\bloi\\b|\\bloa\\b') THEN 'loi-loa'
         WHEN regexp_matches(attachment_text, '(?is)work order|purchase order|order (win|worth|received|bagg)|bags .{{0,20}}order|secures .{{0,20}}(order|contract)|awarded .{{0,20}}(order|contract)|receipt of order') THEN 'firm-order'
         WHEN regexp_matches(attachment_text, '(?is)contract') THEN 'contract-other' END AS event_type
    FROM filings WHERE symbol IS NOT NULL AND announced_at >= TIMESTAMP '{SINCE}' AND category NOT IN ('Price movement', 'Spurt in Volume', 'News Verification')""")
define("typed_events", "SELECT * FROM typed WHERE event_type IS NOT NULL")
define("entries", """SELECT t.*, e.date AS entry_date, e.close AS entry_close, e.sn AS entry_sn, e.t20, e.f1, e.f3, e.f5, e.f10, e.f20, n.nsn, n.close AS n_close, n.n1, n.n3, n.n5, n.n10, n.n20,
    CASE WHEN n.close >= n.sma50 THEN 'up' ELSE 'down' END AS regime
    FROM typed_events t ASOF JOIN fwd e ON e.ticker = t.symbol AND e.date > t.tradeable_after LEFT JOIN bfwd n ON n.date = e.date""")
define("order_values_t", f"SELECT v.*, symbol FROM ({order_value_sql.order_values('filings', 'seq_id', 'attachment_text')}) v JOIN filings USING (seq_id)")
define("candidate_tagged", """SELECT c.*, x.seq_id IS NOT NULL AS has_catalyst, v.value_cr AS catalyst_value_cr, x.event_type AS catalyst_type
    FROM candidate_outcomes c LEFT JOIN LATERAL (SELECT seq_id, event_type FROM entries e WHERE e.symbol = c.ticker AND e.entry_sn <= c.entry_sn AND e.entry_sn > c.entry_sn - 10
      ORDER BY e.entry_sn DESC, e.seq_id LIMIT 1) x ON TRUE LEFT JOIN order_values_t v ON v.seq_id = x.seq_id AND v.confidence = 'high'""")


def filing_order_values(t):
    """(seq_id, symbol, value_cr, confidence, n_candidates, evidence) of every filing, by the order-value operator."""
    return order_values.order_values_of_repeats(t.filings.select("seq_id", "symbol", "attachment_text"), "seq_id", "attachment_text")


def tagged(t):
    from barframe.operators import ledger

    priced = sessions.with_session_number(t.eod)
    ent = ledger.entries(ledger.typed_events(t.filings, SINCE), priced.select("ticker", "date", "close", "sn"), sessions.benchmark_series(t.index))
    return screener.tag_catalysts(_outcomes(t), ent, filing_order_values(t), priced)


@query("candidate_catalysts", "Q11 J8 ST5", "SELECT * FROM candidate_tagged", "entry_close exc_5 exc_10 catalyst_value_cr")
def _(t):
    return tagged(t)


_stats = "count(*) AS n, avg(exc_5) AS mean, 1e2 * avg(CASE WHEN exc_5 > 0 THEN 1e0 ELSE 0e0 END) AS win_pct"


@query("catalyst_report", "Q12 A1 A2", f"SELECT direction, has_catalyst, {_stats}, avg(exc_10) AS mean_10, quantile_cont(exc_5, 0.5) AS median FROM candidate_tagged WHERE exc_5 IS NOT NULL GROUP BY 1, 2", "mean win_pct mean_10 median")
def _(t):
    return screener.catalyst_report(tagged(t), by_direction=True)


@query("catalyst_report_split", "Q12 P11 A2", f"SELECT CASE WHEN entry_date < DATE '{SPLIT}' THEN 'TRAIN' ELSE 'TEST' END AS period, has_catalyst, {_stats}, avg(exc_10) AS mean_10, quantile_cont(exc_5, 0.5) AS median FROM candidate_tagged WHERE exc_5 IS NOT NULL GROUP BY 1, 2", "mean win_pct mean_10 median")
def _(t):
    return screener.catalyst_report(tagged(t), split=SPLIT)


# ---- reads ----------------------------------------------------------------------------------
define("breadth", "SELECT 'NSE:ALL' AS index_name, date, 0e0 AS pct_change, count(*) FILTER (WHERE close > prev_close) AS advance, count(*) FILTER (WHERE close < prev_close) AS decline FROM sess GROUP BY date")


@query("market_breadth", "A4", "SELECT * FROM breadth", "pct_change")
def _(t):
    return feed.market_breadth(sessions.with_previous_close(t.eod))


define("snapshot", "SELECT * FROM breadth UNION ALL SELECT ticker, date, 1e2 * (close / prev_close - 1e0), NULL, NULL FROM sess WHERE prev_close IS NOT NULL")
define("flows", "SELECT date, sum(CASE WHEN sn % 2 = 0 THEN close ELSE 0 END) AS fii_buy, sum(CASE WHEN sn % 2 = 1 THEN close ELSE 0 END) AS fii_sell, sum(high) AS dii_buy, sum(low) AS dii_sell FROM sess GROUP BY date")


def snapshot(t):
    b = sessions.with_previous_close(t.eod)
    rows = b.where("prev_close is not null").select(
        c("ticker").alias("index_name"), "date", (F.lit(100.0) * (c("close") / c("prev_close") - 1.0)).alias("pct_change"),
        F.lit(None).cast("long").alias("advance"), F.lit(None).cast("long").alias("decline"))
    return feed.market_breadth(b).unionByName(rows)


def flows(t):
    s = sessions.with_session_number(t.eod)
    odd = c("sn") % 2 == 1
    return s.groupBy("date").agg(
        F.sum(F.when(~odd, c("close")).otherwise(0.0)).alias("fii_buy"), F.sum(F.when(odd, c("close")).otherwise(0.0)).alias("fii_sell"),
        F.sum("high").alias("dii_buy"), F.sum("low").alias("dii_sell"))


@query("dashboard", "A5 O6", """SELECT s.*, index_name IN ('BRB', 'BRC') AS is_key, b.*, f.* FROM (SELECT * FROM snapshot WHERE date = (SELECT max(date) FROM snapshot)) s,
    (SELECT sum(coalesce(advance, 0))::BIGINT AS breadth_advance, sum(coalesce(decline, 0))::BIGINT AS breadth_decline FROM snapshot WHERE date = (SELECT max(date) FROM snapshot)) b,
    (SELECT date AS flow_date, fii_buy - fii_sell AS fii_net, dii_buy - dii_sell AS dii_net FROM flows ORDER BY date DESC LIMIT 1) f""", "pct_change fii_net dii_net")
def _(t):
    return feed.dashboard(snapshot(t), flows(t), ("BRB", "BRC"))


@query("stocks_heatmap", "P14 J2 O1 X21", """SELECT e.ticker AS symbol, k.name, floor((e.close - i.close_prev) / i.close_prev * 1e4 + 5e-1) / 1e2 AS pct_change,
    CAST(floor(coalesce(sqrt(base * greatest(liq, base * 1e-1)), liq) + 5e-1) AS BIGINT) AS market_cap, k.sector, e.volume
    FROM (SELECT * FROM eod WHERE date = DATE '2000-06-05' ORDER BY close * volume DESC, ticker LIMIT 20) e JOIN ind i ON i.ticker = e.ticker AND i.date = e.date
    JOIN (SELECT *, CASE market_cap_category WHEN 'large' THEN 5e12 WHEN 'mid' THEN 4e11 WHEN 'small' THEN 6e10 WHEN 'micro' THEN 1.2e10 END AS base FROM companies) k ON k.ticker = e.ticker,
    LATERAL (SELECT greatest(e.close, 1e0) * greatest(CASE WHEN i.avg_vol20 > 0 THEN i.avg_vol20 ELSE e.volume END, 1e0) * 1e2 AS liq)""", "pct_change")
def _(t):
    return feed.heatmap(t.eod, t.companies, indicators.indicator_history(t.eod, skip_first=False, min_bars=1), "2000-06-05", 20)


@query("load_audit", "S20 U2", """SELECT 'eod' AS table_name, count(*) AS n_rows, count(DISTINCT date) AS n_sessions, min(date) AS first_date, max(date) AS last_date FROM eod
    UNION ALL SELECT 'idx', count(*), count(DISTINCT date), min(date), max(date) FROM idx""")
def _(t):
    one = lambda n, df: reports.load_audit(df, "date").select(F.lit(n).alias("table_name"), "*")
    return one("eod", t.eod).unionByName(one("idx", t.index))


@query("table_counts", "U2 S20", "SELECT 'eod' AS table_name, count(*) AS n FROM eod UNION ALL SELECT 'filings', count(*) FROM filings UNION ALL SELECT 'items', count(*) FROM items")
def _(t):
    return reports.table_counts({"eod": t.eod, "filings": t.filings, "items": t.items})


@query("mapping_coverage", "S21 U4", """SELECT count(*) AS liquid, count(m) AS mapped FROM (SELECT DISTINCT ticker FROM sess WHERE t20 >= 1e8)
    LEFT JOIN (SELECT DISTINCT symbol AS m FROM filings WHERE sm_industry = 'Banks') ON m = ticker""")
def _(t):
    liquid = sessions.with_turnover(t.eod).where(c("t20") >= 1e8)
    return reports.mapping_coverage(liquid, t.filings.where("sm_industry = 'Banks'"), "ticker", "symbol")
