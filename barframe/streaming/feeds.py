"""Continuous ingestion with Structured Streaming.

The unit of work is the micro-batch: it plays the part of one poll. Near-duplicates are
removed inside it, known ids are dropped against the stored events, and what remains is both
stored and passed on. Restart after failure is the checkpoint's business; a batch that is
replayed inserts nothing twice, because the sink is keyed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barframe.operators.feed import NOTIFY_SCORE, process_items
from barframe.sources.scans import intraday_bars
from barframe.sources.sinks import insert_new

c = F.col
ITEM_SCHEMA = "item_no long, source string, title string, link string, snippet string, published_at timestamp"


def landed_items(spark: SparkSession, path: str, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ITEM_SCHEMA).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def _start(df: DataFrame, handle, checkpoint_dir: str, every: str | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def poll_feeds(
    items: DataFrame, events_table: str, alerts_table: str, checkpoint_dir: str, as_of=None, every: str | None = None,
    min_alert: float = NOTIFY_SCORE,
) -> StreamingQuery:
    """Items to scored events; fresh high-impact ones also to the alert table.

    ``as_of`` fixes the scoring time; by default it is the newest publication time of the batch.
    ``every`` (such as "15 minutes") keeps polling; without it, what has landed is processed.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        now = as_of or batch.agg(F.max("published_at")).first()[0]
        # Both writes carry the epoch's number: if the first was done when the run died, the replay
        # finds its rows again, and the alerts are made from the same fresh events.
        fresh = insert_new(process_items(batch, now, "item_no"), events_table, ["id"], f"epoch-{epoch}")
        hot = fresh.where(c("impact_score") >= min_alert)
        insert_new(hot.select("id", "impact_score", "ticker", "title", "link", "published_at"), alerts_table, ["id"], f"epoch-{epoch}")

    return _start(items, handle, checkpoint_dir, every)


def unseen_items(items: DataFrame, id_col: str = "id", ts: str = "published_at", horizon: str = "3 days") -> DataFrame:
    """Exact-id deduplication as pure stream state, bounded by a watermark."""
    return items.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([id_col])


def rolling_capture(raw: DataFrame, bars_table: str, checkpoint_dir: str, source: str = "capture", every: str | None = None) -> StreamingQuery:
    """Overlapping re-reads of recent bars; repeats are absorbed by the key."""

    def handle(batch: DataFrame, epoch: int) -> None:
        insert_new(intraday_bars(batch, source), bars_table, ["ticker", "interval", "ts"], f"epoch-{epoch}", by=F.to_date("ts"))

    return _start(raw, handle, checkpoint_dir, every)


def within_days(events: DataFrame, as_of, days: int, ts: str = "published_at") -> DataFrame:
    """Recency look-back from a fixed moment: the ``days`` up to it, nothing after it."""
    now = F.lit(as_of).cast("timestamp")
    return events.where((c(ts) >= now - F.make_dt_interval(F.lit(days))) & (c(ts) <= now))
