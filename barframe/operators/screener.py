"""Rule-based screener: universe, setups, catalyst boost, historical replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators.ledger import COST_PCT, MIN_TURNOVER, excess_columns
from barframe.operators.reports import outcome_report
from barframe.operators.sessions import benchmark_series, session_helpers, with_forward_close, with_forward_index

MIN_CLOSE = 200.0
MIN_VOLUME = 100_000
TOP_N = 100
VERSION = "v1"
CATALYST_SCORE = 6.0
CATALYST_DAYS = 5
LOOKBACK_SESSIONS = 10

c = F.col


# A setup is a function direction -> boolean column; NULL inputs make it not match.
def dma_pullback(direction: str) -> Column:
    """Close back across its 20-day mean, in the direction of the trend."""
    if direction == "long":
        return (c("weekly_trend") == "UP") & (c("close_prev") < c("sma20_prev")) & (c("close") > c("sma20"))
    return (c("weekly_trend") == "DOWN") & (c("close_prev") > c("sma20_prev")) & (c("close") < c("sma20"))


def _turning(now: str, low: float, high: float) -> Callable[[str], Column]:
    def setup(direction: str) -> Column:
        prev = c(f"{now}_prev")
        if direction == "long":
            return (c("weekly_trend") == "UP") & (prev < low) & (c(now) > prev)
        return (c("weekly_trend") == "DOWN") & (prev > high) & (c(now) < prev)
    return setup


rsi_reaction = _turning("rsi7", 40.0, 60.0)
stoch_reaction = _turning("stoch_k", 20.0, 80.0)


def confluence(direction: str) -> Column:
    return dma_pullback(direction) & rsi_reaction(direction) & stoch_reaction(direction)


_BASE = ["weekly_trend", "roc20"]
SETUPS: dict[str, tuple[Callable[[str], Column], list[str]]] = {
    "dma-pullback": (dma_pullback, ["close", "close_prev", "sma20", "sma20_prev"] + _BASE),
    "rsi-reaction": (rsi_reaction, ["close", "rsi7", "rsi7_prev"] + _BASE),
    "stoch-reaction": (stoch_reaction, ["close", "stoch_k", "stoch_k_prev"] + _BASE),
    "confluence": (confluence, [
        "close", "close_prev", "sma20", "sma20_prev", "rsi7", "rsi7_prev", "stoch_k", "stoch_k_prev"] + _BASE),
}


def tradeable(indicators: DataFrame, min_close: float = MIN_CLOSE, min_volume: int = MIN_VOLUME,
              price_col: str = "close") -> DataFrame:
    return indicators.where((c(price_col) > min_close) & (c("volume") > min_volume) & c("roc20").isNotNull())


def universe(indicators: DataFrame, prices: DataFrame, date=None, top_n: int = TOP_N) -> DataFrame:
    """Top names by momentum on one date (default: the latest indicator date)."""
    ind = indicators.drop("close", "volume", "open", "high", "low", "close_raw")
    if date is None:
        latest = ind.agg(F.max("date").alias("date"))
        ind = ind.join(F.broadcast(latest), "date")  # one row
    else:
        ind = ind.where(c("date") == F.lit(date).cast("date"))
    joined = ind.join(prices.select("ticker", "date", "close", "volume"), ["ticker", "date"])
    return tradeable(joined).orderBy(c("roc20").desc_nulls_last(), "ticker").limit(top_n)


def ranked_universe(indicators: DataFrame, top_n: int = TOP_N, price_col: str = "close_raw") -> DataFrame:
    """The same on every date; rank limits are applied before the shuffle as well."""
    w = Window.partitionBy("date").orderBy(c("roc20").desc(), "ticker")
    return tradeable(indicators, price_col=price_col).withColumn("rn", F.row_number().over(w)).where(c("rn") <= top_n)


def run_setups(rows: DataFrame, setups=SETUPS, version: str = VERSION, values: bool = True) -> DataFrame:
    """One row per matched (setup, direction): all rules are evaluated in one pass."""
    hits = []
    for name, (rule, fields) in setups.items():
        for direction in ("long", "short"):
            parts = [x for f in fields for x in (F.lit(f), c(f).cast("string"))]
            hits.append(F.when(rule(direction), F.struct(
                F.lit(name).alias("setup"), F.lit(direction).alias("direction"),
                F.lit(f"{name}-{direction}@{version}").alias("setup_name"),
                (F.create_map(*parts) if values else F.lit(None).cast("map<string,string>")).alias("screen_values"),
            )))
    out = rows.withColumn("_h", F.explode(F.array_compact(F.array(*hits))))
    return out.select("ticker", "date", "roc20", "_h.*")


def catalysts(events: DataFrame, as_of, days: int = CATALYST_DAYS, min_score: float = CATALYST_SCORE) -> DataFrame:
    """Highest-impact event per ticker in the ``days`` up to ``as_of``, none after it (latest, then id, on ties)."""
    now = F.lit(as_of).cast("timestamp")
    recent = events.where(
        c("ticker").isNotNull() & (c("impact_score") >= min_score)
        & (c("published_at") >= now - F.make_dt_interval(F.lit(days))) & (c("published_at") <= now)
    )
    best = F.max_by(
        F.struct(c("id").alias("catalyst_event_id"), c("title").alias("catalyst_title"), c("impact_score").alias("catalyst_score")),
        F.struct("impact_score", "published_at", "id"),
    )
    return recent.groupBy("ticker").agg(best.alias("e")).select("ticker", "e.*")


def boost(candidates: DataFrame, catalyst: DataFrame) -> DataFrame:
    """Candidates with their catalyst, catalyst first, then by momentum."""
    return candidates.join(catalyst, "ticker", "left").orderBy(
        c("catalyst_event_id").isNotNull().desc(), c("roc20").desc_nulls_last(), "ticker", "setup_name"
    )


def nightly(indicators: DataFrame, prices: DataFrame, events: DataFrame, as_of, date=None, top_n: int = TOP_N) -> DataFrame:
    """The whole nightly run for one date; write it with ``replace_partitions``."""
    return boost(run_setups(universe(indicators, prices, date, top_n)), catalysts(events, as_of))


def replay(history: DataFrame, top_n: int = TOP_N, setups=SETUPS) -> DataFrame:
    """Every date's candidates (``history`` carries the adjusted close next to the raw one)."""
    return run_setups(ranked_universe(history, top_n), setups, values=False).select(
        "ticker", "date", "setup", "direction", "roc20"
    )


def price_candidates(
    candidates: DataFrame, adj: DataFrame, index_prices: DataFrame, index_name: str | None = None,
    horizons=(5, 10), cost: float = COST_PCT, min_turnover: float = MIN_TURNOVER,
) -> DataFrame:
    """Enter at the next session's close, signed excess over the benchmark."""
    bars = with_forward_close(session_helpers(adj), horizons).select(
        "ticker", "date", "close", "sn", "t20", *[f"fwd_close_{h}" for h in horizons]
    )
    bench = with_forward_index(benchmark_series(index_prices, index_name), horizons)
    at_entry = bars.join(bench.drop("index_name", "open", "sma50").withColumnRenamed("close", "n_close"), "date")
    at_entry = at_entry.where((c("t20") >= min_turnover) & (c("close") > 0)).withColumnsRenamed(
        {"date": "entry_date", "close": "entry_close", "sn": "entry_sn"}
    )
    signal = candidates.join(bars.select("ticker", "date", (c("sn") + 1).alias("entry_sn")), ["ticker", "date"])
    return signal.join(at_entry, ["ticker", "entry_sn"]).select(
        "ticker", c("date").alias("signal_date"), "setup", "direction", "entry_sn", "entry_date", "entry_close",
        *excess_columns(horizons, "entry_close", "n_close", "direction", cost),
    )


def tag_catalysts(
    outcomes: DataFrame, event_entries: DataFrame, order_values: DataFrame, bars: DataFrame,
    lookback: int = LOOKBACK_SESSIONS,
) -> DataFrame:
    """Latest catalyst of the preceding sessions, or none.

    Events are first reduced to one per (ticker, entry session) and carried forward along the
    sessions; a candidate then needs one equality join, not a range join with every event.
    """
    high = order_values.where("confidence = 'high'").select("seq_id", "value_cr")
    e = event_entries.join(high, "seq_id", "left")
    per_session = e.groupBy(c("symbol").alias("ticker"), c("entry_sn").alias("sn")).agg(
        F.min(F.struct("seq_id", "event_type", "value_cr")).alias("ev")
    )
    sessions = bars.select("ticker", "sn").join(per_session, ["ticker", "sn"], "left")
    w = Window.partitionBy("ticker").orderBy("sn").rowsBetween(-(lookback - 1), 0)
    carried = sessions.select(
        "ticker", c("sn").alias("entry_sn"), F.last("ev", ignorenulls=True).over(w).alias("cat")
    )
    return outcomes.join(carried, ["ticker", "entry_sn"], "left").select(
        *outcomes.columns, c("cat").isNotNull().alias("has_catalyst"),
        c("cat.value_cr").alias("catalyst_value_cr"), c("cat.event_type").alias("catalyst_type"),
    )


def catalyst_report(tagged: DataFrame, split: str | None = None, by_direction: bool = False) -> DataFrame:
    from barframe.functions.numbers import period_label

    keys = ["has_catalyst"]
    if by_direction:
        keys = ["direction"] + keys
    if split:
        tagged, keys = tagged.withColumn("period", period_label(c("entry_date"), split)), ["period"] + keys
    return outcome_report(tagged, keys, "exc_5", extra={"mean_10": F.avg("exc_10")})


def setup_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("setup_name").agg(F.count(F.lit(1)).alias("n"))
