"""The derived tables in SQL, for checking the Spark results with another engine.

``statement`` prepends exactly the common table expressions a query needs.
"""

from __future__ import annotations

import re

from barframe.plans.tables import INDUSTRY, SINCE, TEXTS

WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def r(x: str, d: int = 4) -> str:
    return f"(floor(({x}) * 1e{d} + 5e-1) / 1e{d})"


def case(col: str, table: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def letters(x: str) -> str:
    return f"translate(CAST({x} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


def strip_html(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '{WS}+', ' ', 'g'))"


def norm_text(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9_]+', ' ', 'g'))"


def ist(ts: str) -> str:
    return f"({ts} + INTERVAL 330 MINUTE)"


def erf(x: str) -> str:
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs({x})))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    return f"(sign({x}) * (1e0 - {poly} * exp(-({x}) * ({x}))))"


def ncdf(x: str) -> str:
    return f"(5e-1 * (1e0 + {erf(f'(({x}) / sqrt(2e0))')}))"


TICKER = "'BR' || " + letters("p_partkey // 80")
_TEXT = "CASE o_orderkey % 8 " + " ".join(
    f"WHEN {i} THEN '{a}' || CAST(floor(o_totalprice / 1e3) AS BIGINT) || '{b}'" for i, (a, b) in enumerate(TEXTS)
) + " END"

CTES = {
    "trades": f"""SELECT {TICKER} AS ticker, p_partkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
        (CAST(l_shipdate AS DATE) - DATE '1970-01-01')::BIGINT * 281474976710656 + l_orderkey * 1024 + l_linenumber * 128 + l_partkey % 128 AS ord,
        {r('1e2 * ln(1e0 + l_extendedprice / l_quantity)', 2)} AS px, l_quantity AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "eod": """SELECT ticker, date, arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close,
        CAST(sum(qty) * 1000 AS BIGINT) AS volume,
        arg_max(px, ord) * (1 + any_value(p_partkey // 80) % 2) AS close_raw FROM trades GROUP BY 1, 2""",
    "idx": """SELECT 'BENCH' AS index_name, date, """ + ", ".join(
        f"CAST(sum(CAST(floor({x} * 1e2 + 5e-1) AS BIGINT)) AS DOUBLE) / count(*) / 1e2 AS {x}" for x in ("open", "high", "low", "close")
    ) + " FROM eod GROUP BY date",
    "vix": f"""SELECT 'VOLX' AS index_name, date, {r('sd * 4e0')} AS close FROM (
        SELECT date, CASE WHEN count(ret) OVER w = 10 THEN stddev_samp(ret) OVER w END AS sd FROM (
          SELECT date, 1e2 * ln(close / lag(close) OVER (ORDER BY date)) AS ret FROM idx)
        WINDOW w AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE sd IS NOT NULL""",
    "sess": """SELECT *, row_number() OVER w AS sn, lag(close) OVER w AS prev_close,
        avg(close_raw * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS t20,
        avg(CAST(volume AS DOUBLE)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS avgvol20
        FROM eod WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "bench": """SELECT date, open, close, row_number() OVER (ORDER BY date) AS nsn,
        avg(close) OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma50 FROM idx""",
    "action_plan": """SELECT a.ticker, s.date AS true_date, s.date - 3 AS ex_date, subject, f FROM (
        SELECT ticker, n * 3 % 60 + 30 AS sn, 'Bonus 1:1' AS subject, 5e-1 AS f FROM nums
        UNION ALL SELECT ticker, n * 2 % 220 + 110, 'Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share', 2e-1 FROM nums
        UNION ALL SELECT ticker, n * 2 % 220 + 110, 'Bonus 1:2', 2e0 / 3e0 FROM nums WHERE n % 5 = 0
        UNION ALL SELECT ticker, n % 290 + 60, 'Interim Dividend - Rs 2 Per Share', NULL FROM nums) a
        JOIN sess s ON s.ticker = a.ticker AND s.sn = a.sn""",
    "nums": "SELECT DISTINCT ticker, CAST(translate(substr(ticker, 3), 'ABCDEFGHIJ', '0123456789') AS BIGINT) AS n FROM eod",
    "actions": """SELECT ticker, ex_date, subject, CASE WHEN subject LIKE 'Bonus%' THEN 'bonus' WHEN subject LIKE 'Face%' THEN 'split' ELSE 'dividend' END AS action_type,
        f AS adj_factor FROM action_plan""",
    "raw": "SELECT ticker, date, " + ", ".join(f"{r(f'{x} / cum', 2)} AS {x}" for x in ("open", "high", "low", "close")) + """, volume FROM (
        SELECT e.*, coalesce((SELECT product(f) FROM action_plan a WHERE a.ticker = e.ticker AND a.true_date > e.date AND f IS NOT NULL), 1e0) AS cum FROM eod e)""",
    "filings": f"""SELECT o_orderkey AS filing_no, 'nse:' || o_orderkey AS seq_id, {TICKER} AS symbol,
        o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS announced_at,
        CASE WHEN o_orderkey % 13 = 0 THEN 'Price movement' WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS category,
        'Company ' || {TICKER} AS company_name, {case('p_type', INDUSTRY)} AS sm_industry, {_TEXT} AS attachment_text
        FROM orders JOIN (SELECT l_orderkey, min(l_linenumber::BIGINT * 1099511627776 + l_partkey) % 1099511627776 AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
        JOIN part ON p_partkey = p""",
    "page_items": f"""SELECT page_id * 2 + 1 AS item_no, 'rss' AS source, {strip_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        CASE WHEN page_id % 5 = 0 THEN 'https://www.google.com/url?rct=j&sa=t&url=' || url || '&ct=ga' ELSE url END AS link,
        substr({strip_html('html')}, 1, 500) AS snippet, TIMESTAMP '2001-08-05' + to_seconds(page_id * 60) AS published_at FROM pages""",
    "items": """SELECT filing_no * 2 AS item_no, 'nse' AS source, symbol || ': ' || coalesce(category, 'Announcement') AS title,
        'https://filings.example.com/' || filing_no AS link, attachment_text AS snippet, announced_at AS published_at FROM filings
        UNION ALL SELECT * FROM page_items""",
    "modal_type": f"""SELECT ticker, p_type FROM (SELECT {TICKER} AS ticker, p_type, count(*) AS n FROM part GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, p_type) = 1""",
    "companies": """SELECT ticker, 'Company ' || ticker AS name, p_type AS sector,
        CASE CAST(translate(substr(ticker, 3), 'ABCDEFGHIJ', '0123456789') AS BIGINT) % 5 WHEN 0 THEN 'large' WHEN 1 THEN 'mid' WHEN 2 THEN 'small' WHEN 3 THEN 'micro' END AS market_cap_category
        FROM modal_type""",
    "intraday": f"""SELECT ticker, ts, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, count(*) * 1000000 AS volume, '60m' AS interval_
        FROM (SELECT 'U' || {letters('user_id')} AS ticker, date_trunc('hour', ts) AS ts, epoch_us(ts) AS o, value + 1e2 AS px FROM events) GROUP BY 1, 2""",
    "user_days": f"""SELECT ticker, CAST({ist('ts')} AS DATE) AS date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
        CAST(sum(volume) AS BIGINT) AS volume FROM intraday GROUP BY 1, 2""",
    "eod_x": "SELECT * REPLACE (CAST(date + INTERVAL 10 YEAR AS DATE) AS date) FROM eod",
    "vix_x": "SELECT * REPLACE (CAST(date + INTERVAL 10 YEAR AS DATE) AS date) FROM vix",
    "chain_in": """SELECT ticker, date AS trade_date, close AS underlying, volume AS v, e, k, option_type,
        last_day(CAST(date + to_months(CAST(e AS INTEGER)) AS DATE)) AS expiry, floor(close / 2e1 + 5e-1) * 2e1 + k * 2e1 AS strike, close * (1e0 + e * 2e-3) AS fwd
        FROM eod_x, (SELECT unnest([0, 1]) AS e), (SELECT unnest(range(-3, 4)) AS k), (SELECT unnest(['CE', 'PE']) AS option_type)""",
    "chain_vol": """SELECT *, exp(-0.065e0 * tte) AS df, (ln(fwd / strike) + 5e-1 * vol * vol * tte) / sq AS d1 FROM (
        SELECT *, greatest(vol * sqrt(tte), 1e-12) AS sq FROM (
        SELECT *, (expiry - trade_date) / 365e0 AS tte,
        2e-1 + dayofyear(trade_date) * 4e-4 + (strike / fwd - 1e0) * (strike / fwd - 1e0) * 8e-1 - (strike / fwd - 1e0) * 1e-1 + e * 2e-2 AS vol FROM chain_in))""",
    "chain": f"""SELECT trade_date, ticker, expiry, strike, option_type, close AS open, {r('close * 1.1e0', 2)} AS high, {r('close * 0.9e0', 2)} AS low, close, underlying,
        CAST(floor(v / 1e3 + abs(k) * 700 + 50) AS BIGINT) AS volume FROM (
        SELECT *, greatest({r(f"CASE WHEN option_type = 'CE' THEN df * (fwd * {ncdf('d1')} - strike * {ncdf('d1 - sq')}) ELSE df * (strike * {ncdf('sq - d1')} - fwd * {ncdf('-d1')}) END", 2)}, 5e-2) AS close
        FROM chain_vol)""",
    "fills": """SELECT ticker || strftime(expiry, '%y') || upper(strftime(expiry, '%b')) || CAST(strike AS BIGINT) || option_type AS symbol,
        CASE p WHEN 0 THEN 0e0 WHEN 4 THEN last ELSE first END AS buy,
        CASE p WHEN 1 THEN 0e0 WHEN 4 THEN first WHEN 5 THEN last * 5e1 ELSE last END AS sell, last - first AS pnl, ticker, expiry, strike, option_type
        FROM (SELECT ticker, expiry, strike, option_type, arg_min(close, trade_date) AS first, arg_max(close, trade_date) AS last, CAST(floor(strike / 20) AS BIGINT) % 7 AS p FROM chain GROUP BY 1, 2, 3, 4)""",
}


def statement(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` with every common table expression it refers to, directly or not."""
    table = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str, seen: tuple) -> None:
        for name in table:
            if name in needed or name in seen:
                continue
            if re.search(rf"(?<![\w.'])\b{name}\b(?!\s*\()(?!')", sql):
                visit(table[name], seen + (name,))
                if name not in needed:
                    needed.append(name)

    visit(query, ())
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({table[n]})" for n in needed) + "\n" + query
