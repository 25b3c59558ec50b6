"""Adjustment, event ledger, sectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.filings import parse_action
from barframe.operators import adjust, ledger, reports, sectors, sessions
from barframe.operators.asof import join_nearest
from barframe.plans import q_bars
from barframe.plans.registry import define, query
from barframe.plans.tables import SINCE

c = F.col

# ---- adjustment -----------------------------------------------------------------------------
define("same_day", "SELECT ticker, ex_date, exp(sum(ln(adj_factor))) AS combined, count(*) AS n_actions FROM actions WHERE adj_factor > 0 GROUP BY 1, 2")
define("gap_candidates", """SELECT ticker, ex_date, combined, date, close / lag(close) OVER (PARTITION BY ticker, ex_date ORDER BY date) AS ratio, count(*) OVER (PARTITION BY ticker, ex_date) AS n_bars
    FROM same_day JOIN raw USING (ticker) WHERE date BETWEEN ex_date - 6 AND ex_date + 6""")
define("best_gap", """SELECT *, abs(ln(ratio) - ln(combined)) AS err FROM gap_candidates WHERE ratio > 0
    QUALIFY row_number() OVER (PARTITION BY ticker, ex_date ORDER BY abs(ln(ratio) - ln(combined)), date) = 1""")
define("detected", """SELECT s.ticker, s.ex_date, s.combined, s.n_actions, CASE WHEN b.err <= ln(1.25e0) THEN b.date END AS effective_date,
    CASE WHEN b.ticker IS NULL THEN 'no price data in window'
         WHEN b.err <= ln(1.25e0) THEN 'matched ratio ' || printf('%.4f', b.ratio) || ' vs expected ' || printf('%.4f', s.combined)
         ELSE 'no matching gap (best ratio ' || printf('%.4f', b.ratio) || ' vs expected ' || printf('%.4f', s.combined) || ')' END AS detection_note
    FROM same_day s LEFT JOIN best_gap b USING (ticker, ex_date)""")
define("located", "SELECT a.*, d.effective_date, d.detection_note FROM actions a LEFT JOIN detected d USING (ticker, ex_date)")
define("adj", """SELECT ticker, date, open * cum AS open, high * cum AS high, low * cum AS low, close * cum AS close, close AS close_raw, volume, cum AS adj_factor FROM (
    SELECT r.*, coalesce((SELECT exp(sum(ln(adj_factor))) FROM located a WHERE a.ticker = r.ticker AND a.effective_date > r.date AND adj_factor > 0), 1e0) AS cum FROM raw r)""")


def located(t):
    return adjust.with_effective_dates(t.actions, adjust.detect_effective_dates(t.actions, t.raw))


def adjusted(t):
    return adjust.back_adjust(t.raw, located(t))


@query("same_day_factors", "L1 A6", "SELECT * FROM same_day", "combined")
def _(t):
    return adjust.combine_same_day(t.actions)


@query("detect_split_dates", "L2", "SELECT * FROM detected", "combined")
def _(t):
    return adjust.detect_effective_dates(t.actions, t.raw)


@query("effective_date_drift", "A8", "SELECT (effective_date - ex_date)::BIGINT AS drift_days, count(*) AS n FROM located WHERE effective_date IS NOT NULL GROUP BY 1")
def _(t):
    return adjust.drift_histogram(located(t))


@query("adjusted_prices", "L3 J7 S18", "SELECT * FROM adj", "open high low close close_raw adj_factor")
def _(t):
    return adjusted(t)


define("audit", """SELECT a.ticker, a.effective_date AS ex_date, a.adj_factor, 1e2 * (q.close_raw - p.close_raw) / p.close_raw AS raw_gap_pct, 1e2 * (q.close - p.close) / p.close AS adj_gap_pct
    FROM (SELECT * FROM located WHERE adj_factor <> 1 AND effective_date IS NOT NULL) a
    ASOF JOIN adj p ON p.ticker = a.ticker AND p.date < a.effective_date ASOF JOIN adj q ON q.ticker = a.ticker AND q.date >= a.effective_date""")
_audit = "SELECT *, abs(adj_gap_pct) > 25 AS suspicious FROM audit"


@query("adjustment_audit", "L4 J5", _audit, "adj_factor raw_gap_pct adj_gap_pct")
def _(t):
    return adjust.adjustment_audit(adjusted(t), located(t))


@query("largest_adjustments", "O8", f"SELECT * FROM ({_audit}) ORDER BY abs(1 - adj_factor) DESC, ticker, ex_date LIMIT 15", "adj_factor raw_gap_pct adj_gap_pct")
def _(t):
    return adjust.largest_adjustments(adjust.adjustment_audit(adjusted(t), located(t)))


@query("corporate_action_subjects", "X22 S9", """SELECT ticker, ex_date, subject, CASE WHEN subject LIKE '%Bonus%' THEN 'bonus' WHEN subject LIKE '%Consol%' THEN 'consolidation' WHEN subject LIKE '%Split%' THEN 'split' WHEN subject LIKE '%Dividend%' THEN 'dividend' ELSE 'other' END AS action_type,
    CASE WHEN subject LIKE '%Bonus%' THEN b / (a + b) WHEN subject LIKE '%From%' THEN y / x END AS adj_factor FROM (
    SELECT symbol AS ticker, CAST(announced_at AS DATE) AS ex_date, CAST(1 + filing_no % 5 AS DOUBLE) AS a, CAST(1 + filing_no % 3 AS DOUBLE) AS b, CAST(1 + filing_no % 10 AS DOUBLE) AS x, CAST(2 + filing_no % 7 AS DOUBLE) AS y,
    CASE filing_no % 5 WHEN 0 THEN 'Bonus Issue ' || (1 + filing_no % 5) || ':' || (1 + filing_no % 3) WHEN 1 THEN CASE WHEN 2 + filing_no % 7 > 1 + filing_no % 10 THEN 'Consolidation' ELSE 'Face Value Split' END || ' From Rs ' || (1 + filing_no % 10) || '/- Per Share To Re ' || (2 + filing_no % 7) || '/- Per Share'
      WHEN 2 THEN 'Interim Dividend - Rs 2 Per Share' WHEN 3 THEN 'Stock Split' ELSE 'Annual General Meeting' END AS subject FROM filings)""", "adj_factor")
def _(t):
    n = c("filing_no")
    s = lambda k: k.cast("string")
    a, b, x, y = 1 + n % 5, 1 + n % 3, 1 + n % 10, 2 + n % 7
    face = F.concat(F.when(y > x, "Consolidation").otherwise("Face Value Split"), F.lit(" From Rs "), s(x), F.lit("/- Per Share To Re "), s(y), F.lit("/- Per Share"))
    subject = (
        F.when(n % 5 == 0, F.concat(F.lit("Bonus Issue "), s(a), F.lit(":"), s(b))).when(n % 5 == 1, face)
        .when(n % 5 == 2, "Interim Dividend - Rs 2 Per Share").when(n % 5 == 3, "Stock Split").otherwise("Annual General Meeting")
    )
    rows = t.filings.select(c("symbol").alias("ticker"), F.to_date("announced_at").alias("ex_date"), subject.alias("subject"))
    kind, factor = parse_action("subject")
    return rows.select("*", kind.alias("action_type"), factor.alias("adj_factor"))


# ---- ledger ---------------------------------------------------------------------------------


@query("typed_events", "L6 X23 P6 X9", "SELECT * FROM typed_events")
def _(t):
    return ledger.typed_events(t.filings, SINCE)


@query("next_session_entry", "J4 L7 W3", "SELECT seq_id, symbol, event_type, entry_date, entry_close, entry_sn, t20, regime FROM entries", "entry_close t20")
def _(t):
    priced = sessions.session_helpers(t.eod).select("ticker", "date", "close", "sn", "t20")
    e = ledger.entries(ledger.typed_events(t.filings, SINCE), priced, sessions.benchmark_series(t.index))
    return e.select("seq_id", "symbol", "event_type", "entry_date", "entry_close", "entry_sn", "t20", "regime")


@query("previous_session", "J5", """SELECT a.seq_id, p.date AS before_date, p.close AS before_close FROM typed_events a ASOF LEFT JOIN eod p ON p.ticker = a.symbol AND p.date < a.tradeable_after""", "before_close")
def _(t):
    out = join_nearest(
        ledger.typed_events(t.filings, SINCE), t.eod, probe_key="symbol", probe_date="tradeable_after", payload=["close"],
        direction="backward", prefix="before_", how="left",
    )
    return out.select("seq_id", "before_date", "before_close")


define("kept_entries", """SELECT * FROM (SELECT *, lag(entry_sn) OVER (PARTITION BY symbol ORDER BY entry_sn, seq_id) AS prev_sn FROM entries) WHERE prev_sn IS NULL OR entry_sn - prev_sn > 3""")


@query("overlap_collapse", "L8 W5", "SELECT seq_id, symbol, entry_sn FROM kept_entries")
def _(t):
    priced = sessions.with_session_number(t.eod).select("ticker", "date", "close", "sn")
    e = ledger.entries(ledger.typed_events(t.filings, SINCE), priced, sessions.benchmark_series(t.index))
    return ledger.collapse_overlaps(e, 3).select("seq_id", "symbol", "entry_sn")


_h = lambda h: f"1e2 * (f{h} / entry_close - 1e0) AS ret_{h}, 1e2 * (f{h} / entry_close - 1e0) - 1e2 * (n{h} / n_close - 1e0) - 0.35e0 AS exc_{h}"
define("outcomes", f"SELECT seq_id, symbol, event_type, category, announced_at, entry_date, entry_close, t20 AS turnover_20d, regime, {', '.join(_h(h) for h in (1, 3, 5, 10, 20))} FROM kept_entries WHERE entry_close > 0 AND t20 >= 5e7 AND nsn IS NOT NULL")
_cols = " ".join(f"ret_{h} exc_{h}" for h in (1, 3, 5, 10, 20))


def outcomes(t):
    return ledger.event_outcomes(ledger.typed_events(t.filings, SINCE), t.eod, t.index, horizons=(1, 3, 5, 10, 20), overlap=3)


@query("event_outcomes", "L9 J6 L12", "SELECT * FROM outcomes", "entry_close turnover_20d " + _cols)
def _(t):
    return outcomes(t)


_agg = "count(*) AS n, avg(exc_5) AS mean, 1e2 * avg(CASE WHEN exc_5 > 0 THEN 1e0 ELSE 0e0 END) AS win_pct"


@query("base_rates", "L10 A1", f"SELECT event_type, {_agg}, quantile_cont(exc_10, 0.5) AS median_10, quantile_cont(exc_5, 0.5) AS median, count(*) < 30 AS thin FROM outcomes WHERE exc_5 IS NOT NULL GROUP BY 1", "mean win_pct median_10 median")
def _(t):
    return ledger.base_rates(outcomes(t))


@query("base_rates_by_regime", "L10 A2", f"SELECT event_type, regime, {_agg}, quantile_cont(exc_10, 0.5) AS median_10, quantile_cont(exc_5, 0.5) AS median, count(*) < 30 AS thin FROM outcomes WHERE exc_5 IS NOT NULL GROUP BY 1, 2", "mean win_pct median_10 median")
def _(t):
    return ledger.base_rates(outcomes(t), ["event_type", "regime"])


define("control_entries", f"""SELECT t.seq_id, t.symbol, e.date AS entry_date, e.close AS entry_close, e.sn AS entry_sn, e.t20, e.f5, n.n5, n.close AS n_close, n.nsn
    FROM (SELECT * FROM typed WHERE event_type IS NULL AND category IN ('1-URGENT', '2-HIGH')) t ASOF JOIN fwd e ON e.ticker = t.symbol AND e.date > t.tradeable_after LEFT JOIN bfwd n ON n.date = e.date""")


@query("control_group", "L11", f"""SELECT 'control' AS event_type, {_agg}, quantile_cont(exc_5, 0.5) AS median, count(*) < 30 AS thin FROM (
    SELECT 1e2 * (f5 / entry_close - 1e0) - 1e2 * (n5 / n_close - 1e0) - 0.35e0 AS exc_5 FROM (SELECT *, lag(entry_sn) OVER (PARTITION BY symbol ORDER BY entry_sn, seq_id) AS prev_sn FROM control_entries)
    WHERE (prev_sn IS NULL OR entry_sn - prev_sn > 3) AND t20 >= 5e7 AND nsn IS NOT NULL) WHERE exc_5 IS NOT NULL""", "mean win_pct median")
def _(t):
    ev = ledger.control_events(t.filings, ["1-URGENT", "2-HIGH"], SINCE)
    out = ledger.event_outcomes(ev, t.eod, t.index, horizons=(5,), overlap=3)
    return reports.outcome_report(out, ["event_type"], "exc_5", flag_thin=True)


@query("outcomes_by_sector", "L12", f"SELECT sector, {_agg}, quantile_cont(exc_5, 0.5) AS median, count(*) < 30 AS thin FROM outcomes LEFT JOIN companies ON ticker = symbol WHERE exc_5 IS NOT NULL GROUP BY 1", "mean win_pct median")
def _(t):
    return ledger.by_sector(outcomes(t), t.companies, "exc_5")


@query("outcomes_by_order_size", "L12 P9", """SELECT CASE WHEN value_cr < 25 THEN 'a: <25' WHEN value_cr < 100 THEN 'b: 25-100' WHEN value_cr < 500 THEN 'c: 100-500' WHEN value_cr < 2000 THEN 'd: 500-2000' ELSE 'e: 2000+' END AS size_bucket,
    count(*) AS n, avg(exc_20) AS mean, 1e2 * avg(CASE WHEN exc_20 > 0 THEN 1e0 ELSE 0e0 END) AS win_pct, quantile_cont(exc_20, 0.5) AS median, count(*) < 30 AS thin
    FROM outcomes JOIN order_values_t USING (seq_id) WHERE confidence = 'high' AND exc_20 IS NOT NULL GROUP BY 1""", "mean win_pct median")
def _(t):
    return ledger.by_order_size(outcomes(t), q_bars.filing_order_values(t), "exc_20")


define("adj_sess", """SELECT *, row_number() OVER w AS sn, avg(close_raw * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS t20,
    lead(close, 5) OVER w AS f5, lead(close, 10) OVER w AS f10 FROM adj WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
define("adj_entries", """SELECT t.*, e.close AS entry_close, e.sn AS entry_sn, e.t20, e.f5, e.f10, n.nsn, n.close AS n_close, n.n5, n.n10
    FROM typed_events t ASOF JOIN adj_sess e ON e.ticker = t.symbol AND e.date > t.tradeable_after LEFT JOIN bfwd n ON n.date = e.date""")


@query("full_ledger", "L3 L9 L10", f"""SELECT event_type, count(*) AS n, avg(exc_5) AS mean, 1e2 * avg(CASE WHEN exc_5 > 0 THEN 1e0 ELSE 0e0 END) AS win_pct, quantile_cont(exc_10, 0.5) AS median_10, quantile_cont(exc_5, 0.5) AS median, count(*) < 30 AS thin FROM (
    SELECT *, 1e2 * (f5 / entry_close - 1e0) - 1e2 * (n5 / n_close - 1e0) - 0.35e0 AS exc_5, 1e2 * (f10 / entry_close - 1e0) - 1e2 * (n10 / n_close - 1e0) - 0.35e0 AS exc_10 FROM (
      SELECT *, lag(entry_sn) OVER (PARTITION BY symbol ORDER BY entry_sn, seq_id) AS prev_sn FROM adj_entries) WHERE (prev_sn IS NULL OR entry_sn - prev_sn > 10) AND entry_close > 0 AND t20 >= 5e7 AND nsn IS NOT NULL)
    WHERE exc_5 IS NOT NULL GROUP BY 1""", "mean win_pct median_10 median")
def _(t):
    return ledger.base_rates(ledger.event_outcomes(ledger.typed_events(t.filings, SINCE), adjusted(t), t.index))


# ---- sectors --------------------------------------------------------------------------------


@query("modal_industry", "A7 L13", """SELECT symbol, sm_industry, n FROM (SELECT symbol, sm_industry, count(*) AS n FROM filings WHERE sm_industry IS NOT NULL AND sm_industry <> '-' GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, sm_industry) = 1""")
def _(t):
    return reports.modal_value(t.filings.where("sm_industry <> '-'"), "symbol", "sm_industry")


define("modal_ind", """SELECT symbol, sm_industry FROM (SELECT symbol, sm_industry, count(*) AS n FROM filings WHERE sm_industry IS NOT NULL AND sm_industry <> '-' GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, sm_industry) = 1""")
define("labelled", """SELECT k.ticker, k.name, CASE WHEN k.ticker IN ('BRB', 'BRCC') THEN 'Defence' ELSE coalesce(CASE m.sm_industry WHEN 'Construction' THEN 'Infrastructure' WHEN 'Power' THEN 'Infrastructure'
    WHEN 'Banks' THEN 'Financials' WHEN 'Pharmaceuticals' THEN 'Pharma' END, m.sm_industry, k.sector) END AS sector, k.market_cap_category FROM companies k LEFT JOIN modal_ind m ON m.symbol = k.ticker""")


def labelled(t):
    return sectors.assign_sectors(t.companies, t.filings, overrides={"Defence": ("BRB", "BRCC")})


@query("assign_sectors", "L13 J16 X21", "SELECT * FROM labelled")
def _(t):
    return labelled(t)


@query("sector_sizes", "L13 O1", "SELECT coalesce(sector, '(none)') AS sector, count(*) AS n FROM labelled GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12")
def _(t):
    return sectors.sector_sizes(labelled(t))


@query("missing_companies", "J17 S14", "SELECT symbol AS ticker, max(company_name) AS name FROM filings WHERE symbol NOT IN (SELECT ticker FROM companies WHERE market_cap_category = 'large') GROUP BY 1")
def _(t):
    return sectors.missing_companies(t.companies.where("market_cap_category = 'large'"), t.filings)
