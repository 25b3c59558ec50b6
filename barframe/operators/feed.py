"""From raw feed items to scored, deduplicated events, and the reads on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions import extraction as X
from barframe.functions.filings import setup_direction
from barframe.functions.numbers import daily_change_pct, size_estimate
from barframe.functions.text import contains_ignore_case, content_id
from barframe.operators.dedup import deduplicate
from barframe.operators.sessions import bind
from barframe.sources.sinks import first_per_key

c = F.col
NOTIFY_SCORE, ENRICH_SCORE, ENRICH_DAYS = 7.0, 6.0, 3
POLL_MINUTES = 15
# Indices shown first.
KEY_INDICES = ("NIFTY 50", "NIFTY BANK", "NIFTY MIDCAP 150")


def extract(items: DataFrame) -> DataFrame:
    """All text facts of ``title`` + ``snippet`` in one pass over the keyword list."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    df = bind(bind(items, _text=text, _low=F.lower(text)), _hits=X.keyword_hits(c("_low")))
    return df.select(
        *items.columns,
        X.ticker(c("_text")).alias("ticker"), X.company_name(c("_text")).alias("company_name"),
        X.primary_sector(c("_hits")).alias("sector"), X.category_tags(c("_hits")).alias("sector_tags"),
        X.order_value(c("_low")).alias("order_value"), X.order_unit(c("_low")).alias("order_value_unit"),
        X.contract_kind(c("_low")).alias("contract_type"), X.matched_keywords(c("_hits")).alias("matched_keywords"),
    )


def score(extracted: DataFrame, as_of) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    details = X.impact_score(
        c("matched_keywords"), c("sector_tags"), c("order_value"), c("order_value_unit"), c("published_at"), now
    )
    return bind(extracted, score_details=details).withColumn("impact_score", c("score_details.total_score"))


def to_events(items: DataFrame, as_of) -> DataFrame:
    return score(extract(items), as_of).withColumn("id", content_id("title", "link"))


def with_poll(items: DataFrame, minutes: int = POLL_MINUTES, ts: str = "published_at") -> DataFrame:
    """The poll that an item belongs to: the ``minutes`` in which it came out."""
    return items.withColumn("poll", F.floor(F.unix_seconds(ts) / (60 * minutes)))


def process_items(items: DataFrame, as_of, order: str, batch: list[str] | None = None) -> DataFrame:
    """Unique items of a poll as events; ``insert_new`` on ``id`` then yields the fresh ones.

    Items are dealt to all cores before their texts are read: the few bytes of a poll would come as one task.
    """
    session = items.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    events = to_events(deduplicate(items, order=order, batch=batch).repartition(tasks), as_of)
    return first_per_key(events, (batch or []) + ["id"], [c(order)])


def feed(events: DataFrame, min_score: float = 1.0, after=None, before=None, limit: int = 50) -> DataFrame:
    rows = events.where(c("impact_score") >= max(1.0, min_score))
    if before is not None:
        rows = rows.where(c("published_at") <= F.lit(before).cast("timestamp"))
    if after is not None:
        rows = rows.where(c("published_at") >= F.lit(after).cast("timestamp"))
    return rows.orderBy(c("published_at").desc(), "id").limit(min(200, max(1, limit)))


def search(events: DataFrame, query: str) -> DataFrame:
    fields = [c(x) for x in ("ticker", "company_name", "title", "snippet", "sector")]
    return events.where(contains_ignore_case(fields, [c("matched_keywords"), c("sector_tags")], query))


def alert_digest(fresh: DataFrame, min_score: float = NOTIFY_SCORE, n: int = 10) -> DataFrame:
    """Highest new events with the text lines of a message."""
    rows = fresh.where(c("impact_score") >= min_score).orderBy(c("impact_score").desc(), c("published_at").desc(), "id").limit(n)
    amount = F.when(
        c("order_value").isNotNull() & c("order_value_unit").isNotNull(),
        F.concat(F.lit("₹"), c("order_value").cast("string"), F.lit(" "), c("order_value_unit")),
    )
    return rows.select("id", "impact_score", "ticker", F.substring("title", 1, 150).alias("headline"), amount.alias("amount"), "link")


def enrichment_worklist(events: DataFrame, as_of, n: int = 10, min_score: float = ENRICH_SCORE) -> DataFrame:
    """What is still to be analysed of the last days up to ``as_of``, none after it."""
    now = F.lit(as_of).cast("timestamp")
    since = now - F.make_dt_interval(F.lit(ENRICH_DAYS))
    return events.where(
        (c("impact_score") >= min_score) & c("ai_analysis").isNull() & (c("published_at") >= since) & (c("published_at") <= now)
    ).orderBy(c("impact_score").desc(), c("published_at").desc(), "id").limit(n)


def candidate_list(
    candidates: DataFrame, companies: DataFrame, events: DataFrame, date, setup: str | None = None, direction: str | None = None,
) -> DataFrame:
    """One date's candidates with company and catalyst columns."""
    rows = candidates.where(c("date") == F.lit(date).cast("date"))
    if setup:
        rows = rows.where(c("setup_name").startswith(setup))
    if direction:
        rows = rows.where(setup_direction("setup_name") == direction)
    names = companies.select("ticker", c("name").alias("company_name"), "sector", "market_cap_category")
    cat = events.select(
        c("id").alias("catalyst_event_id"), c("title").alias("catalyst_title"), c("impact_score").alias("catalyst_score")
    )
    keep = [x for x in rows.columns if x not in ("catalyst_title", "catalyst_score")]
    return rows.select(*keep).join(names, "ticker", "left").join(cat, "catalyst_event_id", "left")


def heatmap(prices: DataFrame, companies: DataFrame, indicators: DataFrame, date=None, limit: int = 60) -> DataFrame:
    """Most traded names of a day with change and tile size.

    The day's top names are cut first; only they meet the other tables.
    """
    if date is None:
        prices = prices.join(F.broadcast(prices.agg(F.max("date").alias("date"))), "date")  # one row
    else:
        prices = prices.where(c("date") == F.lit(date).cast("date"))
    top = prices.select("ticker", "date", "close", "volume").orderBy(
        (c("close") * c("volume")).desc(), "ticker").limit(min(200, max(1, limit)))
    j = top.join(companies, "ticker", "left").join(
        indicators.select("ticker", "date", "close_prev", "avg_vol20"), ["ticker", "date"], "left"
    )
    return j.select(
        c("ticker").alias("symbol"), F.coalesce("name", "ticker").alias("name"),
        daily_change_pct(c("close"), c("close_prev")).alias("pct_change"),
        size_estimate(c("market_cap_category"), c("close"), c("volume"), c("avg_vol20")).alias("market_cap"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"), "volume",
    )


def market_breadth(bars: DataFrame, name: str = "NSE:ALL") -> DataFrame:
    """Advances and declines per date as a pseudo-index row (``prev_close`` required)."""
    return bars.groupBy("date").agg(
        F.count_if(c("close") > c("prev_close")).alias("advance"), F.count_if(c("close") < c("prev_close")).alias("decline")
    ).select(F.lit(name).alias("index_name"), "date", F.lit(0.0).alias("pct_change"), "advance", "decline")


def dashboard(snapshot: DataFrame, flows: DataFrame, key_indices=KEY_INDICES) -> DataFrame:
    """Latest snapshot rows, marked key indices, breadth totals and the latest flows."""
    latest = snapshot.join(F.broadcast(snapshot.agg(F.max("date").alias("date"))), "date")  # one row
    breadth = latest.agg(
        F.sum(F.coalesce("advance", F.lit(0))).cast("long").alias("breadth_advance"),
        F.sum(F.coalesce("decline", F.lit(0))).cast("long").alias("breadth_decline"),
    )
    last_flow = flows.orderBy(c("date").desc()).limit(1).select(
        c("date").alias("flow_date"), (c("fii_buy") - c("fii_sell")).alias("fii_net"), (c("dii_buy") - c("dii_sell")).alias("dii_net")
    )
    return latest.withColumn("is_key", c("index_name").isin(*key_indices)).join(F.broadcast(breadth)).join(
        F.broadcast(last_flow), how="left"
    )
