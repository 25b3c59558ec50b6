"""Nearest-row joins along a time axis.

Probes are reduced to distinct (key, date) pairs first. A window over bars and probe dates
is then bounded by the calendar, no matter how many probe rows share an instrument or a day,
and the full probe rows come back by a plain equi-join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _marked(probes: DataFrame, bars: DataFrame, probe_key, probe_date, bar_key, bar_date, payload):
    dates = probes.select(
        F.col(probe_key).alias("_k"), F.col(probe_date).alias("_d"),
        F.lit(True).alias("_probe"),
    ).where("_k is not null and _d is not null").distinct()
    row = F.struct(F.col(bar_date).alias("date"), *[F.col(c) for c in payload if c != bar_date])
    rows = bars.select(
        F.col(bar_key).alias("_k"), F.col(bar_date).alias("_d"), F.lit(False).alias("_probe"), row.alias("_row")
    )
    return rows.unionByName(dates.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))


def join_nearest(
    probes: DataFrame, bars: DataFrame, *, probe_key: str, probe_date: str,
    bar_key: str = "ticker", bar_date: str = "date", payload: list[str],
    direction: str = "forward", strict: bool = True, prefix: str = "", how: str = "inner",
) -> DataFrame:
    """First bar after (``forward``) or last bar before (``backward``) each probe date.

    ``strict`` excludes a bar on the probe date itself.
    """
    marked = _marked(probes, bars, probe_key, probe_date, bar_key, bar_date, payload)
    # Scan towards the probe from the side the answer lies on, so the frame only ever grows
    # (linear). At equal dates the order decides whether a bar on the probe date counts.
    day = F.col("_d").desc() if direction == "forward" else F.col("_d").asc()
    tie = F.col("_probe").desc() if strict else F.col("_probe").asc()
    frame = Window.partitionBy("_k").orderBy(day, tie).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_row", ignorenulls=True).over(frame)
    hit = marked.withColumn("_hit", found).where("_probe").select("_k", "_d", "_hit")
    if how == "inner":
        hit = hit.where("_hit is not null")
    names = ["date"] + [c for c in payload if c != bar_date]
    hit = hit.select("_k", "_d", *[F.col("_hit")[n].alias(prefix + n) for n in names])
    cond = (F.col(probe_key) == F.col("_k")) & (F.col(probe_date) == F.col("_d"))
    return probes.join(hit, cond, how).drop("_k", "_d")
