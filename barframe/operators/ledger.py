"""Point-in-time event-outcome ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.dates import tradeable_after
from barframe.functions.filings import EVENT_RULES, NO_NEWS_CATEGORIES, event_type
from barframe.functions.numbers import bucket
from barframe.operators.asof import join_nearest
from barframe.operators.reports import outcome_report
from barframe.operators.sessions import benchmark_series, session_helpers, with_forward_close, with_forward_index

COST_PCT = 0.35
MIN_TURNOVER = 50_000_000.0
OVERLAP_SESSIONS = 10
HORIZONS = (1, 3, 5, 10)


def typed_events(filings: DataFrame, since: str = "2019-10-01", rules=EVENT_RULES) -> DataFrame:
    """Filings with a type and the date after which they can be traded.

    A NULL category is dropped, as SQL's NOT IN does.
    """
    return (
        filings.where(
            F.col("symbol").isNotNull() & (F.col("announced_at") >= F.lit(since).cast("timestamp"))
            & ~F.col("category").isin(*NO_NEWS_CATEGORIES)
        )
        .select(
            "seq_id", "symbol", "category", "announced_at",
            tradeable_after("announced_at").alias("tradeable_after"),
            event_type("attachment_text", rules).alias("event_type"),
        )
        .where("event_type is not null")
    )


def control_events(filings: DataFrame, routine: list[str], since: str = "2019-10-01") -> DataFrame:
    """Control group: routine filings of given categories that match no rule."""
    return (
        filings.where(
            F.col("symbol").isNotNull() & (F.col("announced_at") >= F.lit(since).cast("timestamp"))
            & F.col("category").isin(*routine)
        )
        .where(event_type("attachment_text").isNull())
        .select(
            "seq_id", "symbol", "category", "announced_at",
            tradeable_after("announced_at").alias("tradeable_after"), F.lit("control").alias("event_type"),
        )
    )


def entries(events: DataFrame, priced: DataFrame, bench: DataFrame) -> DataFrame:
    """First session strictly after the news, with everything known at that session.

    ``priced``: bars with ``sn``, ``t20`` and forward closes. The benchmark columns are added
    to the bars once (one row per date, small by nature and sized by AQE), so an event needs
    a single join.
    """
    idx = bench.drop("index_name", "open").withColumnRenamed("close", "n_close")
    bars = priced.join(idx, "date", "left")
    payload = [c for c in bars.columns if c not in ("ticker", "open", "high", "low", "volume")]
    return join_nearest(
        events, bars, probe_key="symbol", probe_date="tradeable_after", payload=payload,
    ).withColumnsRenamed({"date": "entry_date", "close": "entry_close", "sn": "entry_sn"}).withColumn(
        "regime", F.when(F.col("n_close") >= F.col("sma50"), "up").otherwise("down")
    )


def collapse_overlaps(df: DataFrame, gap: int = OVERLAP_SESSIONS) -> DataFrame:
    """Drop an event entered within ``gap`` sessions of the previous entry on its symbol.

    The previous entry counts whether or not it was kept itself. Events of one entry session
    are zero sessions apart, so only the first (by id) can stay; the distance is then taken
    over distinct entry sessions, never over all events of a symbol.
    """
    firsts = df.groupBy("symbol", "entry_sn").agg(F.min("seq_id").alias("seq_id"))
    w = Window.partitionBy("symbol").orderBy("entry_sn")
    firsts = firsts.withColumn("_prev", F.lag("entry_sn").over(w)).where(
        F.col("_prev").isNull() | (F.col("entry_sn") - F.col("_prev") > gap)
    ).drop("_prev")
    return df.join(firsts, ["symbol", "entry_sn", "seq_id"], "left_semi")


def _signed(direction: Column | None, leg: Column) -> Column:
    return leg if direction is None else F.when(direction == "long", leg).otherwise(-leg)


def excess_columns(
    horizons, entry: str, bench_entry: str, direction: str | None = None, cost: float = COST_PCT,
    returns: bool = False,
) -> list[Column]:
    """Return and cost-netted excess over the benchmark, signed before the cost."""
    out = []
    for h in horizons:
        stock = F.lit(100.0) * (F.col(f"fwd_close_{h}") / F.col(entry) - 1.0)
        index = F.lit(100.0) * (F.col(f"n_fwd_{h}") / F.col(bench_entry) - 1.0)
        if returns:
            out.append(stock.alias(f"ret_{h}"))
        side = F.col(direction) if direction else None
        out.append((_signed(side, stock - index) - F.lit(cost)).alias(f"exc_{h}"))
    return out


def event_outcomes(
    events: DataFrame, adj: DataFrame, index_prices: DataFrame, index_name: str | None = None,
    horizons=HORIZONS, cost: float = COST_PCT, min_turnover: float = MIN_TURNOVER,
    overlap: int = OVERLAP_SESSIONS,
) -> DataFrame:
    """The ledger: one priced row per surviving event."""
    priced = with_forward_close(session_helpers(adj), horizons).select(
        "ticker", "date", "close", "sn", "t20", *[f"fwd_close_{h}" for h in horizons]
    )
    bench = with_forward_index(benchmark_series(index_prices, index_name), horizons)
    kept = collapse_overlaps(entries(events, priced, bench), overlap)
    return kept.where(
        (F.col("entry_close") > 0) & (F.col("t20") >= min_turnover) & F.col("nsn").isNotNull()
    ).select(
        "seq_id", "symbol", "event_type", "category", "announced_at", "entry_date", "entry_close",
        F.col("t20").alias("turnover_20d"), "regime",
        *excess_columns(horizons, "entry_close", "n_close", cost=cost, returns=True),
    )


def base_rates(outcomes: DataFrame, keys: list[str] = ["event_type"], h: int = 5, h_long: int = 10) -> DataFrame:
    return outcome_report(
        outcomes, keys, f"exc_{h}", medians={f"median_{h_long}": f"exc_{h_long}"}, flag_thin=True
    )


# Order-size steps in crore.
SIZE_BUCKETS = [(25.0, "a: <25"), (100.0, "b: 25-100"), (500.0, "c: 100-500"), (2000.0, "d: 500-2000")]


def by_sector(outcomes: DataFrame, companies: DataFrame, value: str) -> DataFrame:
    joined = outcomes.join(companies.select(F.col("ticker").alias("symbol"), "sector"), "symbol", "left")
    return outcome_report(joined, ["sector"], value, flag_thin=True)


def by_order_size(outcomes: DataFrame, order_values: DataFrame, value: str) -> DataFrame:
    high = order_values.where("confidence = 'high'").select("seq_id", "value_cr")
    joined = outcomes.join(high, "seq_id").withColumn(
        "size_bucket", bucket(F.col("value_cr"), SIZE_BUCKETS, "e: 2000+", how="lt")
    )
    return outcome_report(joined, ["size_bucket"], value, flag_thin=True)
