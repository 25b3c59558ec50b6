"""Which windows of a job are still to be loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.sources.sinks import upsert

c = F.col


def day_windows(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Weekdays between two dates as single-day windows."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("start"))
    return days.where(F.weekday("start") < 5).select(
        "start", c("start").alias("end"), c("start").cast("string").alias("window_key")
    )


def span_windows(spark: SparkSession, first: str, last: str, days: int) -> DataFrame:
    """Consecutive windows of ``days`` days, the last one cut at ``last``."""
    end = F.lit(last).cast("date")
    starts = spark.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), end, F.make_interval(days=F.lit(days)))).alias("start"))
    w = starts.withColumn("end", F.least(F.date_add("start", days - 1), end))
    return w.withColumn("window_key", F.concat_ws("_", c("start").cast("string"), c("end").cast("string")))


def quarter_windows(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    starts = spark.range(1).select(F.explode(F.sequence(
        F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-10-01").cast("date"), F.make_interval(months=F.lit(3)))).alias("start"))
    key = F.concat(F.year("start").cast("string"), F.lit("Q"), F.quarter("start").cast("string"))
    return starts.withColumn("end", F.date_sub(F.add_months("start", 3), 1)).withColumn("window_key", key)


def pending(windows: DataFrame, progress: DataFrame, job: str, finished=("done", "holiday")) -> DataFrame:
    done = progress.where((c("job") == job) & c("status").isin(*finished)).select("window_key").distinct()
    return windows.join(done, "window_key", "left_anti")


def checkpoint(progress_rows: DataFrame, table: str) -> DataFrame:
    """Record window results (job, window_key, status, rows, note); a rerun overwrites its key."""
    return upsert(progress_rows, table, ["job", "window_key"])
