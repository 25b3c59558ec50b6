"""Scans of landed exchange and vendor files. Every scan declares its schema: no inference pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.functions.dates import exchange_date, parse_exchange_time
from barframe.functions.filings import parse_action
from barframe.functions.numbers import parse_number
from barframe.functions.text import strip_html
from barframe.sources.sinks import first_per_key, mostly_unique

c = F.col
NO_STRIKE, NO_TYPE = -1.0, "FUT"

# Column names of the landed files.
EQUITY_COLUMNS = ["SYMBOL", "SERIES", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "CLOSE_PRICE", "TTL_TRD_QNTY", "DELIV_PER"]
INDEX_COLUMNS = ["Index Name", "Open Index Value", "High Index Value", "Low Index Value", "Closing Index Value", "Change(%)"]
MASTER_COLUMNS = ["SYMBOL", "NAME OF COMPANY", "SERIES"]
CONTRACT_COLUMNS = [
    "TradDt", "TckrSymb", "XpryDt", "StrkPric", "OptnTp", "FinInstrmTp", "OpnPric", "HghPric", "LwPric", "ClsPric",
    "SttlmPric", "UndrlygPric", "OpnIntrst", "ChngInOpnIntrst", "TtlTradgVol", "TtlTrfVal", "TtlNbOfTxsExctd", "NewBrdLotQty",
]


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, path, columns) -> DataFrame:
    """Padded headers and cells; columns by name, in whatever order the file has them."""
    raw = spark.read.option("header", True).option("inferSchema", False).option(
        "ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    have = {n.strip(): n for n in raw.columns}
    cols = [F.trim(F.col(f"`{have[n]}`")).alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in columns]
    return raw.select(*cols, F.col("_metadata.file_name").alias("_file"))


def file_date(name: Column) -> Column:
    """Trading date out of a file name with DDMMYYYY or YYYYMMDD."""
    eight = F.regexp_extract(name, r"(\d{8})", 1)
    parse = lambda fmt: F.to_date(F.try_to_timestamp(eight, F.lit(fmt)))
    return F.when(eight.rlike("^(19|20)"), F.coalesce(parse("yyyyMMdd"), parse("ddMMyyyy"))).otherwise(parse("ddMMyyyy"))


def equity_eod(spark: SparkSession, path, date: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """Daily equity bars: EQ series, numbers with commas, rows lacking OHLCV dropped, one row per key."""
    raw = _csv(spark, path, EQUITY_COLUMNS + (extra or []))
    num = lambda n: parse_number(F.col(n))
    rows = raw.where(c("SERIES") == "EQ").select(
        c("SYMBOL").alias("ticker"), (file_date(c("_file")) if date is None else date).alias("date"),
        num("OPEN_PRICE").alias("open"), num("HIGH_PRICE").alias("high"), num("LOW_PRICE").alias("low"),
        num("CLOSE_PRICE").alias("close"), F.floor(num("TTL_TRD_QNTY") + 0.5).alias("volume"),
        num("DELIV_PER").alias("delivery_pct"), num("PREV_CLOSE").alias("prev_close"),
    )
    return rows.where((c("ticker") != "") & c("date").isNotNull()).dropna(
        subset=["open", "high", "low", "close", "volume"]
    ).transform(first_per_key, ["ticker", "date"])


def index_eod(spark: SparkSession, path, date: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    raw = _csv(spark, path, INDEX_COLUMNS + (extra or []))
    num = lambda n: parse_number(F.col(f"`{n}`"))
    return raw.select(
        F.upper(F.trim("Index Name")).alias("index_name"), (file_date(c("_file")) if date is None else date).alias("date"),
        num("Closing Index Value").alias("close"), num("Change(%)").alias("pct_change"),
        num("Open Index Value").alias("open"), num("High Index Value").alias("high"), num("Low Index Value").alias("low"),
    ).where((c("index_name") != "") & c("close").isNotNull()).transform(first_per_key, ["index_name", "date"])


def backfill_index_ohlc(index_prices: DataFrame, ohlc: DataFrame) -> DataFrame:
    """Open/high/low onto existing rows only; rows without new values keep theirs."""
    new = ohlc.where("open is not null").select("index_name", "date", *[c(x).alias(f"_{x}") for x in ("open", "high", "low")])
    j = index_prices.join(new, ["index_name", "date"], "left")
    return j.withColumns({x: F.coalesce(f"_{x}", x) for x in ("open", "high", "low")}).drop("_open", "_high", "_low")


def instrument_master(spark: SparkSession, path) -> DataFrame:
    raw = _csv(spark, path, MASTER_COLUMNS)
    return raw.where((c("SERIES") == "EQ") & (c("SYMBOL") != "")).select(
        c("SYMBOL").alias("ticker"), F.coalesce("NAME OF COMPANY", "SYMBOL").alias("name")
    ).transform(first_per_key, ["ticker"])


def _item(source, title, link, snippet, published) -> list[Column]:
    return [
        source.alias("source"), title.alias("title"), link.alias("link"), F.substring(snippet, 1, 500).alias("snippet"),
        published.alias("published_at"),
    ]


FEED_SCHEMA = "title string, link string, description string, pubDate string"


def feed_items(entries: DataFrame, as_of, source: str = "rss", feed_url: str = "") -> DataFrame:
    """RSS entries to raw items: markup stripped, 500-character snippet, empty titles dropped."""
    stamp = F.coalesce(
        F.try_to_timestamp("pubDate"),
        F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.lit(as_of).cast("timestamp"),
    )
    return entries.select(*_item(
        F.lit(source), strip_html(F.coalesce("title", F.lit(""))), F.coalesce("link", F.lit(feed_url)),
        strip_html(F.coalesce("description", F.lit(""))), stamp,
    )).where(c("title") != "")


def rss_feed(spark: SparkSession, path, as_of, source: str = "rss") -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "item").schema(FEED_SCHEMA).load(path)
    return feed_items(raw, as_of, source)


FILING_SCHEMA = (
    "symbol string, sm_name string, sm_isin string, desc string, smIndustry string, attchmntText string, "
    "attchmntFile string, an_dt string, sort_date string, seq_id string"
)
FILING_B_SCHEMA = (
    "NEWSSUB string, HEADLINE string, ATTACHMENTNAME string, NEWS_DT string, SLONGNAME string, SCRIP_CD string"
)


def filing_items(raw: DataFrame, as_of, default_link: str) -> DataFrame:
    """First exchange's filings to raw items, with its fallback chains."""
    return raw.select(*_item(
        F.lit("nse"),
        F.concat(F.coalesce("symbol", "sm_name", F.lit("NSE")), F.lit(": "), F.coalesce("desc", F.lit("Announcement"))),
        F.coalesce("attchmntFile", F.lit(default_link)), F.coalesce("attchmntText", F.lit("")),
        F.coalesce(parse_exchange_time("an_dt"), F.lit(as_of).cast("timestamp")),
    ))


def filing_items_b(raw: DataFrame, as_of, link_base: str, default_link: str) -> DataFrame:
    """Second exchange's filings to raw items."""
    file = F.nullif(c("ATTACHMENTNAME"), F.lit(""))
    return raw.select(*_item(
        F.lit("bse"),
        F.concat(F.coalesce("SLONGNAME", F.lit("BSE")), F.lit(": "), F.coalesce("NEWSSUB", "HEADLINE", F.lit("Announcement"))),
        F.coalesce(F.concat(F.lit(link_base), file), F.lit(default_link)), F.coalesce("HEADLINE", F.lit("")),
        F.coalesce(F.try_to_timestamp("NEWS_DT"), F.lit(as_of).cast("timestamp")),
    ))


def filing_archive(raw: DataFrame, order: Column) -> DataFrame:
    """Archive filings to the raw table: stable key, blanks to NULL, raw JSON kept.

    ``order`` tells which of two rows with one key came last; that one wins (an aggregate with
    map-side combine, so a key repeated without end stays cheap).
    """
    blank = lambda n: F.nullif(F.trim(n), F.lit(""))
    at = F.coalesce(parse_exchange_time("an_dt"), parse_exchange_time("sort_date"))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    composite = F.concat_ws(":", F.coalesce(F.trim("symbol"), F.lit("?")), iso, F.substring(F.coalesce("desc", F.lit("")), 1, 40))
    fields = [f.split()[0] for f in FILING_SCHEMA.split(", ")]
    rows = raw.withColumn("_at", at).where(c("_at").isNotNull()).select(
        F.concat(F.lit("nse:"), F.coalesce(blank("seq_id"), composite)).alias("seq_id"), blank("symbol").alias("symbol"),
        blank("sm_isin").alias("isin"), blank("sm_name").alias("company_name"), blank("desc").alias("category"),
        blank("smIndustry").alias("sm_industry"), c("_at").alias("announced_at"), blank("attchmntText").alias("attachment_text"),
        blank("attchmntFile").alias("attachment_file"), F.to_json(F.struct(*fields)).alias("raw"), order.alias("_ord"),
    )
    body = [x for x in rows.columns if x not in ("seq_id", "_ord")]
    return rows.groupBy("seq_id").agg(F.max_by(F.struct(*body), "_ord").alias("r")).select("seq_id", "r.*")


FLOW_SCHEMA = "category string, date string, buyValue string, sellValue string, netValue string"


def investor_flows(raw: DataFrame) -> DataFrame:
    """Rows per investor category to one wide row per date."""
    cat = F.upper(F.coalesce("category", F.lit("")))
    foreign = F.contains(cat, F.lit("FII")) | F.contains(cat, F.lit("FPI"))
    domestic = ~foreign & F.contains(cat, F.lit("DII"))
    pick = lambda who, n: F.coalesce(F.max(F.when(who, parse_number(c(n)))), F.lit(0.0))
    rows = raw.withColumn("_d", exchange_date(parse_exchange_time("date"))).where(c("_d").isNotNull() & (foreign | domestic))
    return rows.groupBy(c("_d").alias("date")).agg(
        pick(foreign, "buyValue").alias("fii_buy"), pick(foreign, "sellValue").alias("fii_sell"),
        pick(domestic, "buyValue").alias("dii_buy"), pick(domestic, "sellValue").alias("dii_sell"),
    )


ACTION_SCHEMA = (
    "symbol string, comp string, series string, isin string, subject string, exDate string, recDate string, faceVal string"
)


def corporate_actions(raw: DataFrame) -> DataFrame:
    """Actions with type and factor; one row per (ticker, ex_date, subject), so re-runs cannot square factors."""
    kind, factor = parse_action("subject")
    fields = [f.split()[0] for f in ACTION_SCHEMA.split(", ")]
    return raw.select(
        F.trim("symbol").alias("ticker"), exchange_date(parse_exchange_time("exDate")).alias("ex_date"),
        F.trim("subject").alias("subject"), kind.alias("action_type"), factor.alias("adj_factor"),
        F.to_json(F.struct(*fields)).alias("raw"),
    ).where((c("ticker") != "") & c("ex_date").isNotNull() & (c("subject") != "")).transform(first_per_key, ["ticker", "ex_date", "subject"])


def derivatives_eod(spark: SparkSession, path, symbols: list[str] | None = None, include_untraded: bool = False) -> DataFrame:
    """Contract bars: traded rows, futures under sentinel strike and type, one row per key."""
    raw = _csv(spark, path, CONTRACT_COLUMNS)
    dbl = lambda n: c(n).try_cast("double")
    lng = lambda n: dbl(n).cast("long")
    if not include_untraded:
        raw = raw.where(dbl("TtlTradgVol") > 0)
    if symbols:
        raw = raw.where(c("TckrSymb").isin(*symbols))
    blank = lambda n: F.nullif(c(n), F.lit(""))
    rows = raw.select(
        c("TradDt").try_cast("date").alias("trade_date"), c("TckrSymb").alias("ticker"), c("XpryDt").try_cast("date").alias("expiry"),
        F.coalesce(dbl("StrkPric"), F.lit(NO_STRIKE)).alias("strike"), F.coalesce(blank("OptnTp"), F.lit(NO_TYPE)).alias("option_type"),
        c("FinInstrmTp").alias("instr_type"), dbl("OpnPric").alias("open"), dbl("HghPric").alias("high"), dbl("LwPric").alias("low"),
        dbl("ClsPric").alias("close"), dbl("SttlmPric").alias("settle"), dbl("UndrlygPric").alias("underlying"),
        lng("OpnIntrst").alias("oi"), lng("ChngInOpnIntrst").alias("chg_oi"), lng("TtlTradgVol").alias("volume"),
        dbl("TtlTrfVal").alias("turnover"), lng("TtlNbOfTxsExctd").alias("n_trades"), lng("NewBrdLotQty").cast("int").alias("lot_size"),
    )
    return rows.transform(mostly_unique, ["trade_date", "ticker", "expiry", "strike", "option_type"])


INTRADAY_SCHEMA = "ticker string, ts string, interval string, open double, high double, low double, close double, volume double"


def intraday_bars(raw: DataFrame, source: str) -> DataFrame:
    """Intraday bars: NaN prices dropped, missing volume 0, instants normalised, one row per key."""
    prices = ["open", "high", "low", "close"]
    return raw.dropna(subset=prices).select(
        "ticker", "interval", F.try_to_timestamp("ts").alias("ts"), *prices,
        F.coalesce(F.nanvl("volume", F.lit(0.0)), F.lit(0.0)).cast("long").alias("volume"), F.lit(source).alias("source"),
    ).where(c("ts").isNotNull()).transform(first_per_key, ["ticker", "interval", "ts"])


ORDER_VALUE_SCHEMA = "seq_id string, symbol string, status string, value_cr double, confidence string, n_candidates int, evidence string"


def order_value_lines(raw: DataFrame) -> DataFrame:
    finite = ~F.isnan("value_cr") & (F.abs("value_cr") < float("inf"))
    return raw.select(
        "seq_id", "symbol", c("status").alias("pdf_status"), F.when(finite, c("value_cr")).alias("value_cr"),
        F.coalesce("confidence", F.lit("none")).alias("confidence"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "evidence",
    )


def broker_pnl(spark: SparkSession, path) -> DataFrame:
    """Broker P&L export: one row per symbol lifetime."""
    raw = _csv(spark, path, ["Symbol", "Buy Avg", "Sell Avg", "Gross Realised P&L"])
    num = lambda n: parse_number(F.col(f"`{n}`"))
    return raw.select(
        c("Symbol").alias("symbol"), num("Buy Avg").alias("buy"), num("Sell Avg").alias("sell"), num("Gross Realised P&L").alias("pnl")
    )
