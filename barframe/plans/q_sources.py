"""Landed files, sinks, work lists and streams.

Each query lands files derived from the given tables in the shared folder, in the format the
exchange would use, and reads them back through the scan or sink under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.operators import sessions
from barframe.plans import q_bars  # noqa: F401
from barframe.plans.q_text import greedy
from barframe.plans.registry import define, query
from barframe.plans.sql_twins import norm_text, strip_html
from barframe.plans.tables import AS_OF
from barframe.session import scratch_path
from barframe.sources import scans, sinks, worklist
from barframe.streaming import feeds

c = F.col


def land(t, df, fmt, **options):
    path = scratch_path(t.spark, f"landed-{fmt}")
    df.write.options(**options).format(fmt).save(path)
    return path


def shown(x):
    """A number as exchange files print it: thousands commas, padding."""
    return F.concat(F.lit(" "), F.format_number(x, 2))


# ---- scans ------------------------------------------------------------------------------------
def land_days(t, df, day, name):
    """A folder of one CSV file a day, called as an exchange calls it: ``name`` with the day (DDMMYYYY) in it."""
    files = scratch_path(t.spark, "landed-days")
    df.withColumn("_day", F.date_format(day, "ddMMyyyy")).repartition("_day").write.option("header", True).partitionBy("_day").csv(files)
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    fs = path(files).getFileSystem(t.spark._jsc.hadoopConfiguration())
    flat = f"{files}-named"
    fs.mkdirs(path(flat))
    for part in fs.globStatus(path(f"{files}/_day=*/part-*")):  # one file a day
        one = part.getPath()
        fs.rename(one, path(f"{flat}/{name % one.getParent().getName().split('=')[1]}"))
    return flat


def equity_rows(t):
    return sessions.with_previous_close(t.eod).select(
        c("ticker").alias(" SYMBOL "), F.when(c("volume") % 10 == 3, " BE").otherwise(" EQ").alias(" SERIES"), shown("prev_close").alias(" PREV_CLOSE"),
        shown("open").alias(" OPEN_PRICE"), shown("high").alias(" HIGH_PRICE"), shown("low").alias(" LOW_PRICE"),
        F.when(c("volume") % 4000 == 0, "-").otherwise(shown("close")).alias(" CLOSE_PRICE"), c("volume").cast("string").alias(" TTL_TRD_QNTY"),
        F.when(c("volume") % 7 == 0, " -").otherwise(shown((c("volume") % 10000) / 100)).alias(" DELIV_PER"), c("date").cast("string").alias("TRADE_DATE"))


EQUITY_SQL = """SELECT ticker, date, open, high, low, close, volume, prev_close, CASE WHEN volume % 7 <> 0 THEN (volume % 10000) / 1e2 END AS delivery_pct
    FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM eod) WHERE volume % 10 <> 3 AND volume % 4000 <> 0"""


@query("scan_equity_eod", "S1 X10", EQUITY_SQL, "open high low close prev_close delivery_pct")
def _(t):
    path = land(t, equity_rows(t), "csv", header=True)
    return scans.equity_eod(t.spark, path, date=c("TRADE_DATE").cast("date"), extra=["TRADE_DATE"])


@query("scan_equity_daily_files", "S1 X10", f"SELECT * FROM ({EQUITY_SQL}) WHERE date >= DATE '1996-01-01'", "open high low close prev_close delivery_pct")
def _(t):
    """One file a day; the date is the file's name, and files before the wanted days are not read."""
    rows = equity_rows(t)
    days = land_days(t, rows, c("TRADE_DATE").cast("date"), "sec_bhavdata_full_%s.csv")
    return scans.equity_eod(t.spark, days).where("date >= DATE '1996-01-01'")


@query("scan_index_eod", "S2", """SELECT 'BENCH' AS index_name, date, close, open, high, low, CASE WHEN day(date) % 3 <> 0 THEN floor((close / open - 1) * 1e6 + 5e-1) / 1e4 END AS pct_change FROM idx""",
       "close open high low pct_change", digits=2)
def _(t):
    """One file a day, dated by its name."""
    n = lambda x: F.format_number(x, 6)
    change = F.floor((c("close") / c("open") - 1) * 1e6 + 0.5) / 1e4
    rows = t.index.select(
        F.lit("  Bench ").alias("Index Name"), n("open").alias("Open Index Value"), n("high").alias("High Index Value"), n("low").alias("Low Index Value"),
        n("close").alias("Closing Index Value"), F.when(F.dayofmonth("date") % 3 == 0, "-").otherwise(F.format_number(change, 4)).alias("Change(%)"), "date")
    return scans.index_eod(t.spark, land_days(t, rows, c("date"), "ind_close_all_%s.csv"))


@query("index_ohlc_backfill", "S3 S20", "SELECT ticker AS index_name, date, close, CASE WHEN volume % 2 = 0 THEN open END AS open, CASE WHEN volume % 2 = 0 THEN high END AS high, CASE WHEN volume % 2 = 0 THEN low END AS low FROM eod WHERE ticker <> 'BRB'", "close open high low")
def _(t):
    key = c("ticker").alias("index_name")
    empty = [F.lit(None).cast("double").alias(x) for x in ("open", "high", "low")]
    have = t.eod.where("ticker <> 'BRB'").select(key, "date", "close", *empty)
    return scans.backfill_index_ohlc(have, t.eod.where(c("volume") % 2 == 0).select(key, "date", "open", "high", "low"))


@query("scan_instruments", "S4", "SELECT ticker, name FROM companies WHERE sector <> 'SMALL'")
def _(t):
    rows = t.companies.select(c("ticker").alias("SYMBOL"), c("name").alias(" NAME OF COMPANY"), F.when(c("sector") == "SMALL", "BE").otherwise("EQ").alias(" SERIES"))
    return scans.instrument_master(t.spark, land(t, rows, "csv", header=True))


@query("scan_rss_feed", "S5 X7", f"SELECT title, link, snippet, published_at, 'rss' AS source FROM (SELECT {strip_html('title')} AS title, link, {strip_html('snippet')} AS snippet, published_at FROM page_items) WHERE title <> ''")
def _(t):
    items = t.page_items.select("title", "link", c("snippet").alias("description"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("pubDate"))
    path = land(t, items, "xml", rowTag="item", rootTag="channel")
    out = scans.rss_feed(t.spark, path, AS_OF)
    return out.select("title", "link", "snippet", "published_at", "source")


@query("scan_filing_items", "S6", "SELECT 'nse' AS source, symbol || ': ' || coalesce(category, 'Announcement') AS title, 'https://filings.example.com/none' AS link, attachment_text AS snippet, announced_at AS published_at FROM filings")
def _(t):
    raw = t.spark.read.schema(scans.FILING_SCHEMA).json(land(t, filing_json(t), "json"))
    return scans.filing_items(raw, AS_OF, "https://filings.example.com/none")


@query("scan_filing_items_b", "S6", """SELECT 'bse' AS source, coalesce(company_name, 'BSE') || ': ' || coalesce(category, attachment_text) AS title,
    CASE WHEN filing_no % 3 = 0 THEN 'https://b.example.com/none' ELSE 'https://b.example.com/' || filing_no || '.pdf' END AS link, attachment_text AS snippet,
    CASE WHEN filing_no % 5 = 0 THEN TIMESTAMP '""" + AS_OF + """' ELSE announced_at END AS published_at FROM filings""")
def _(t):
    rows = t.filings.select(
        F.when(c("filing_no") % 3 == 0, "").otherwise(F.concat(c("filing_no").cast("string"), F.lit(".pdf"))).alias("ATTACHMENTNAME"),
        c("company_name").alias("SLONGNAME"), c("category").alias("NEWSSUB"), c("attachment_text").alias("HEADLINE"),
        F.when(c("filing_no") % 5 == 0, "soon").otherwise(F.date_format("announced_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("NEWS_DT"))
    raw = t.spark.read.schema("ATTACHMENTNAME string, SLONGNAME string, NEWSSUB string, HEADLINE string, NEWS_DT string").json(land(t, rows, "json"))
    return scans.filing_items_b(raw, AS_OF, "https://b.example.com/", "https://b.example.com/none")


def filing_json(t):
    stamp = F.date_format(F.from_utc_timestamp("announced_at", "Asia/Kolkata"), "dd-MMM-yyyy HH:mm:ss")
    seq = F.when(c("filing_no") % 5 == 0, "  ").otherwise((c("filing_no") - c("filing_no") % 2).cast("string"))
    return t.filings.select(
        c("symbol"), c("company_name").alias("sm_name"), c("category").alias("desc"), c("sm_industry").alias("smIndustry"),
        c("attachment_text").alias("attchmntText"), stamp.alias("an_dt"), seq.alias("seq_id"))


@query("scan_filing_archive", "S7 X3", """SELECT seq_id, arg_max_null(symbol, announced_at) AS symbol, arg_max_null(company_name, announced_at) AS company_name, arg_max_null(category, announced_at) AS category, arg_max_null(sm_industry, announced_at) AS sm_industry,
    max(announced_at) AS announced_at, arg_max_null(attachment_text, announced_at) AS attachment_text, arg_max(raw_seq, announced_at) AS raw_seq, arg_max(raw_at, announced_at) AS raw_at FROM (
      SELECT *, 'nse:' || CASE WHEN filing_no % 5 = 0 THEN coalesce(symbol, '?') || ':' || strftime(announced_at, '%Y-%m-%dT%H:%M:%S') || '.000Z:' || left(coalesce(category, ''), 40) ELSE (filing_no - filing_no % 2)::VARCHAR END AS seq_id,
        CASE WHEN filing_no % 5 = 0 THEN '  ' ELSE (filing_no - filing_no % 2)::VARCHAR END AS raw_seq, strftime(announced_at + INTERVAL 330 MINUTE, '%d-%b-%Y %H:%M:%S') AS raw_at
      FROM (SELECT * EXCLUDE (seq_id) FROM filings)) GROUP BY seq_id""")
def _(t):
    raw = t.spark.read.schema(scans.FILING_SCHEMA).json(land(t, filing_json(t), "json"))
    from barframe.functions.dates import parse_exchange_time

    out = scans.filing_archive(raw, parse_exchange_time("an_dt"))
    kept = lambda x: F.get_json_object("raw", f"$.{x}")
    return out.select("seq_id", "symbol", "company_name", "category", "sm_industry", "announced_at", "attachment_text", kept("seq_id").alias("raw_seq"), kept("an_dt").alias("raw_at"))


@query("scan_investor_flows", "S8 P13", "SELECT date, max(open) FILTER (WHERE ticker = 'BRB') AS fii_buy, max(close) FILTER (WHERE ticker = 'BRB') AS fii_sell, coalesce(max(open) FILTER (WHERE ticker = 'BRC'), 0e0) AS dii_buy, coalesce(max(close) FILTER (WHERE ticker = 'BRC'), 0e0) AS dii_sell FROM eod WHERE ticker IN ('BRB', 'BRC') GROUP BY 1 HAVING count(*) = 2", "fii_buy fii_sell dii_buy dii_sell")
def _(t):
    two = t.eod.where("ticker in ('BRB', 'BRC')")
    both = two.groupBy("date").count().where("count = 2").select("date")
    rows = two.join(both, "date").select(
        F.when(c("ticker") == "BRB", "FII/FPI *").otherwise("DII **").alias("category"), F.date_format("date", "dd-MMM-yyyy").alias("date"),
        F.format_number("open", 2).alias("buyValue"), F.format_number("close", 2).alias("sellValue"))
    return scans.investor_flows(t.spark.read.schema(scans.FLOW_SCHEMA).json(land(t, rows, "json")))


@query("scan_corporate_actions", "S9 X22", "SELECT DISTINCT ticker, ex_date, subject, action_type, adj_factor, strftime(ex_date, '%d-%b-%Y') AS raw_date, ticker || '|' || subject AS raw_rest FROM actions", "adj_factor")
def _(t):
    rows = t.actions.select(c("ticker").alias("symbol"), "subject", F.date_format("ex_date", "dd-MMM-yyyy").alias("exDate"))
    raw = t.spark.read.schema(scans.ACTION_SCHEMA).json(land(t, rows.unionByName(rows), "json"))
    kept = lambda x: F.get_json_object("raw", f"$.{x}")
    return scans.corporate_actions(raw).withColumns({"raw_date": kept("exDate"), "raw_rest": F.concat_ws("|", kept("symbol"), kept("subject"))}).drop("raw")


@query("scan_derivatives", "S10 P13", """SELECT trade_date, ticker, expiry, strike, option_type, 'IDO' AS instr_type, close - 1 AS open, close + 2 AS high, close - 3 AS low, close, close + 5e-1 AS settle, strike + 10 AS underlying,
      volume * 2 AS oi, -(volume % 50) AS chg_oi, volume, close * 4 AS turnover, volume % 77 AS n_trades, (volume % 40 + 1)::INTEGER AS lot_size FROM chain WHERE volume % 5 <> 0
    UNION ALL SELECT trade_date, ticker, expiry, -1, 'FUT', 'STF', NULL, NULL, NULL, max(close), NULL, NULL, 0, 0, max(volume) + 1, NULL, 0, 1 FROM chain GROUP BY 1, 2, 3""",
       "strike open high low close settle underlying turnover")
def _(t):
    text = lambda x: x.cast("string")
    px, v = c("close"), c("volume")
    day = [text(c("trade_date")).alias("TradDt"), c("ticker").alias("TckrSymb"), text(c("expiry")).alias("XpryDt")]
    options = t.chain.select(
        *day, text(c("strike")).alias("StrkPric"), c("option_type").alias("OptnTp"), F.lit("IDO").alias("FinInstrmTp"), text(px - 1).alias("OpnPric"), text(px + 2).alias("HghPric"),
        text(px - 3).alias("LwPric"), text(px).alias("ClsPric"), text(px + 0.5).alias("SttlmPric"), text(c("strike") + 10).alias("UndrlygPric"), text(v * 2).alias("OpnIntrst"),
        text(-(v % 50)).alias("ChngInOpnIntrst"), F.when(v % 5 == 0, "0").otherwise(text(v)).alias("TtlTradgVol"), text(px * 4).alias("TtlTrfVal"), text(v % 77).alias("TtlNbOfTxsExctd"),
        text(v % 40 + 1).alias("NewBrdLotQty"))
    futures = t.chain.groupBy("trade_date", "ticker", "expiry").agg(F.max("close").alias("close"), (F.max("volume") + 1).alias("volume")).select(
        *day, F.lit("STF").alias("FinInstrmTp"), text(px).alias("ClsPric"), text(v).alias("TtlTradgVol"),
        *[F.lit("0").alias(x) for x in ("OpnIntrst", "ChngInOpnIntrst", "TtlNbOfTxsExctd")], F.lit("1").alias("NewBrdLotQty"))
    # Exchanges hand these files out compressed.
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    return scans.derivatives_eod(t.spark, land(t, options.unionByName(futures, allowMissingColumns=True), "csv", header=True, **packed))


@query("scan_intraday", "S11", "SELECT ticker, ts, open, high, low, close, CASE WHEN volume > 1000000 THEN volume ELSE 0 END AS volume FROM intraday WHERE hour(ts) <> 13", "open high low close")
def _(t):
    rows = t.intraday.select(
        "ticker", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "interval", F.when(F.hour("ts") == 13, F.lit(None)).otherwise(c("open")).alias("open"),
        "high", "low", "close", F.when(c("volume") > 1000000, c("volume").cast("double")).alias("volume"))
    raw = t.spark.read.schema(scans.INTRADAY_SCHEMA).json(land(t, rows.unionByName(rows), "json"))
    return scans.intraday_bars(raw, "landed").select("ticker", "ts", "open", "high", "low", "close", "volume")


@query("scan_order_values", "S12", "SELECT seq_id, symbol, 'ok' AS pdf_status, value_cr, CASE WHEN confidence = 'high' THEN 'high' ELSE 'none' END AS confidence, 0::INTEGER AS n_candidates FROM order_values_t", "value_cr")
def _(t):
    rows = q_bars.filing_order_values(t).select("seq_id", "symbol", F.lit("ok").alias("status"), "value_cr", F.when(c("confidence") == "high", "high").alias("confidence"))
    return scans.order_value_lines(t.spark.read.schema(scans.ORDER_VALUE_SCHEMA).json(land(t, rows, "json"))).drop("evidence")


@query("scan_broker_pnl", "S13", "SELECT symbol, buy, sell, pnl FROM fills", "buy sell pnl", digits=2)
def _(t):
    n = lambda x: F.format_number(x, 2)
    rows = t.fills.select(c("symbol").alias("Symbol"), n("buy").alias("Buy Avg"), n("sell").alias("Sell Avg"), n("pnl").alias("Gross Realised P&L"))
    return scans.broker_pnl(t.spark, land(t, rows, "csv", header=True))


# ---- sinks ------------------------------------------------------------------------------------
def table(t, name):
    return scratch_path(t.spark, f"table-{name}")


@query("insert_new_rows", "S14", "SELECT ticker, date, close FROM eod WHERE volume % 3 = 0", "close")
def _(t):
    at = table(t, "eod")
    sinks.insert_new(t.eod.where(c("volume") % 3 != 0).select("ticker", "date", "close"), at, ["ticker", "date"], by=F.year("date"))
    return sinks.insert_new(t.eod.select("ticker", "date", "close"), at, ["ticker", "date"], by=F.year("date"))


@query("upsert_rows", "S15", "SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN close + 1 ELSE close END AS close FROM eod", "close")
def _(t):
    at = table(t, "eod")
    rows = t.eod.select("ticker", "date", "close", "volume")
    sinks.upsert(rows.where(c("volume") % 2 == 0).drop("volume"), at, ["ticker", "date"], by=F.year("date"))
    new = rows.where((c("volume") % 2 != 0) | (c("volume") % 3 == 0))
    return sinks.upsert(new.withColumn("close", F.when(c("volume") % 3 == 0, c("close") + 1).otherwise(c("close"))).drop("volume"), at, ["ticker", "date"], by=F.year("date"))


@query("upsert_columns", "S16", "SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN open ELSE close END AS px, volume FROM eod", "px")
def _(t):
    at = table(t, "part")
    sinks.upsert_columns(t.eod.select("ticker", "date", c("close").alias("px"), "volume"), at, ["ticker", "date"], by=F.year("date"))
    new = t.eod.select("ticker", "date", F.when(c("volume") % 3 == 0, c("open")).alias("px"), F.lit(None).cast("long").alias("volume"))
    return sinks.upsert_columns(new, at, ["ticker", "date"], by=F.year("date"))


@query("replace_partitions", "S17", "SELECT ticker, date, CASE WHEN year(date) = 1997 THEN open ELSE close END AS px, year(date)::INTEGER AS yr FROM eod", "px")
def _(t):
    at = table(t, "parts")
    rows = t.eod.withColumn("yr", F.year("date"))
    sinks.replace_partitions(rows.select("ticker", "date", c("close").alias("px"), "yr"), at, ["yr"])
    sinks.replace_partitions(rows.where("yr = 1997").select("ticker", "date", c("open").alias("px"), "yr"), at, ["yr"])
    return t.spark.read.parquet(at)


@query("rebuild_table", "S18 L5", "SELECT ticker, date, sn::BIGINT AS sn, t20 FROM sess", "t20")
def _(t):
    return sinks.rebuild(sessions.session_helpers(t.eod).select("ticker", "date", "sn", "t20"), table(t, "sessions"))


@query("pending_windows", "S19 ST6", """SELECT d::DATE AS start FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d)
    WHERE isodow(d) < 6 AND d::DATE NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_linenumber = 1)""")
def _(t):
    done = t.read("lineitem").where("l_linenumber = 1").select(
        F.lit("prices").alias("job"), F.to_date("l_shipdate").cast("string").alias("window_key"), F.lit("done").alias("status")).distinct()
    return worklist.pending(worklist.day_windows(t.spark, "1995-01-01", "2001-12-31"), done, "prices").select("start")


@query("truncation_suspects", "S20", "SELECT strftime(o_orderdate, '%Y-%m') AS window_key, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) >= 180")
def _(t):
    from barframe.operators.reports import truncation_suspects

    p = t.read("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("window_key")).agg(F.count(F.lit(1)).alias("rows"))
    return truncation_suspects(p, 180)


@query("column_fill", "S20", "SELECT count(*) AS total, count(category) AS filled_category, count(sm_industry) AS filled_sm_industry FROM filings")
def _(t):
    from barframe.operators.reports import filled_share

    return filled_share(t.filings, ["category", "sm_industry"])


# ---- streams ------------------------------------------------------------------------------------
define("kept_polls", greedy(f"SELECT page_no % 2 AS poll, item_no, {norm_text('p.title')} AS a, url AS u FROM (SELECT *, (item_no - 1) // 2 AS page_no FROM page_items) p JOIN urls USING (item_no)"))


@query("stream_poll_feeds", "ST1 ST2 ST3 ST6", """SELECT id, item_no, impact_score, impact_score >= 3e0 AS alerted FROM feed_events JOIN kept_polls USING (item_no)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY poll, item_no) = 1""", "impact_score")
def _(t):
    """Two polls, the second by a stream that is started again on the first one's checkpoint."""
    src = scratch_path(t.spark, "landed")
    events, alerts, ck = table(t, "events"), table(t, "alerts"), scratch_path(t.spark, "ck")
    for poll in (0, 1):
        page = F.floor((c("item_no") - 1) / 2)
        t.page_items.where(F.pmod(page, F.lit(2)) == poll).write.mode("append").json(src)
        feeds.poll_feeds(feeds.landed_items(t.spark, src), events, alerts, ck, as_of=AS_OF, min_alert=3.0).awaitTermination()
    told = sinks.read_inserted(t.spark, alerts).select("id", F.lit(True).alias("told"))
    stored = sinks.read_inserted(t.spark, events).select("id", "item_no", "impact_score")
    return stored.join(told, "id", "left").select("id", "item_no", "impact_score", F.coalesce("told", F.lit(False)).alias("alerted"))


@query("stream_unseen_items", "ST1", "SELECT item_no FROM page_items")
def _(t):
    src = land(t, t.page_items.unionByName(t.page_items), "json")
    out = scratch_path(t.spark, "unseen")
    q = feeds.unseen_items(feeds.landed_items(t.spark, src), "item_no").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(t.spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(out).select("item_no")


@query("stream_rolling_capture", "ST4", "SELECT ticker, ts, close FROM intraday", "close")
def _(t):
    rows = t.intraday.select("ticker", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "interval", "open", "high", "low", "close", c("volume").cast("double").alias("volume"))
    src = land(t, rows.unionByName(rows), "json")
    bars = table(t, "bars")
    stream = t.spark.readStream.schema(scans.INTRADAY_SCHEMA).json(src)
    feeds.rolling_capture(stream, bars, scratch_path(t.spark, "ck")).awaitTermination()
    return sinks.read_inserted(t.spark, bars).select("ticker", "ts", "close")
