"""Exact quantiles of groups of any size, on one path.

``percentile`` keeps every distinct value of a group in one buffer. Here a group is narrowed down instead:
a mergeable sketch proposes ``GRID`` cut points, the rows between neighbouring cut points are counted exactly,
and the counts tell in which gap each wanted rank lies and which rank it has there. However rough the sketch,
the gaps cover the line, so no rank can be missed; a poor sketch only leaves more rows. Two such steps leave
about one row in ``GRID`` squared, equal values counted as one, and those are ranked.

Rows meet the sketch by a join on the group; the sketches are written first, one short row a group, so the
planner knows their size and broadcasts them only if that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.session import cut

GRID = 64
ACCURACY = 10_000
LEVELS = 2
c = F.col


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & c(a).eqNullSafe(c(b))
    return out


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """NULL-safe join on ``keys``; a side without keys is one row."""
    if not keys:
        return df.crossJoin(F.broadcast(other)) if how == "inner" else df
    renamed = other.select(*[c(k).alias(f"_o_{k}") for k in keys], *[x for x in other.columns if x not in keys])
    return df.join(renamed, _same(keys, [f"_o_{k}" for k in keys]), how).drop(*[f"_o_{k}" for k in keys])


def _narrow(rows: DataFrame, keys: list[str], ranks: DataFrame, zone: str, grid: int, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the gaps that hold a wanted rank, the ranks within them); ``zone`` numbers a group's gaps."""
    points = [i / grid for i in range(1, grid)]
    sketch = cut(rows.groupBy(*keys).agg(F.percentile_approx("_v", points, accuracy).alias("_e")), "quantile-sketch")
    placed = _beside(rows, sketch, keys).withColumn(zone, F.size(F.filter("_e", lambda e: e < c("_v")))).drop("_e")
    counted = placed.groupBy(*keys, zone).agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy(*keys).orderBy(zone)  # at most one row a gap
    counted = counted.withColumn("_below", F.sum("_m").over(order) - c("_m"))
    inside = (c("_rank") >= c("_below")) & (c("_rank") < c("_below") + c("_m"))
    found = cut(_beside(ranks, counted, keys).where(inside).select(
        *keys, zone, "_target", (c("_rank") - c("_below")).alias("_rank")), "quantile-ranks")
    kept = _beside(placed, found.select(*keys, zone).distinct(), [*keys, zone], "left_semi")
    return kept, found


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
    method: str = "linear", grid: int = GRID, accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> probability).

    ``linear`` interpolates like ``percentile_cont``; ``rank`` takes element
    ``floor(p * n)`` of the sorted values. NULL values are ignored; so are groups without any.
    The steps are run when the function is called; the result is read from what they wrote.
    """
    names = [f"_k{i}" for i in range(len(keys))]  # report keys may have any name
    rows = cut(df.select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], c(value).cast("double").alias("_v")).where("_v is not null"), "quantile-values")
    sizes = cut(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "quantile-sizes")
    n, wanted = c("_n"), []
    for i, p in enumerate(probs.values()):
        if method == "linear":
            at = F.lit(p) * (n - 1)
            wanted += [(2 * i, F.floor(at)), (2 * i + 1, F.ceil(at))]
        else:
            wanted += [(2 * i, F.least(n - 1, F.greatest(F.lit(0).cast("long"), F.floor(F.lit(p) * n))))]
    ranks = sizes.where("_n > 0").select(*names, F.explode(F.array(*[
        F.struct(F.lit(t).alias("_target"), r.cast("long").alias("_rank")) for t, r in wanted])).alias("_w")).select(*names, "_w.*")
    within = list(names)
    for level in range(LEVELS):
        rows, ranks = _narrow(rows, within, ranks, f"_z{level}", grid, accuracy)
        within.append(f"_z{level}")
        if level < LEVELS - 1:
            rows = cut(rows, "quantile-rows")
    cells = rows.groupBy(*within, "_v").agg(F.count(F.lit(1)).alias("_m"))
    cells = cells.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*within).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    held = _beside(ranks, cells, within).where((c("_rank") < c("_upto")) & (c("_rank") >= c("_upto") - c("_m")))
    picked = held.groupBy(*names).agg(*[F.max(F.when(c("_target") == t, c("_v"))).alias(f"_q{t}") for t, _ in wanted])
    out = []
    for i, (name, p) in enumerate(probs.items()):
        a = c(f"_q{2 * i}")
        if method == "linear":
            at, b = F.lit(p) * (n - 1), c(f"_q{2 * i + 1}")
            a = F.when(F.ceil(at) == F.floor(at), a).otherwise(a + (b - a) * (at - F.floor(at)))
        out.append(a.alias(name))
    return _beside(picked, sizes, names).where("_n > 0").select(*[c(k).alias(o) for k, o in zip(names, keys, strict=True)], *out)


def with_quantiles(stats: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Attach quantile columns to a per-group report (left, NULL-safe on the keys)."""
    if not keys:
        return stats.join(F.broadcast(quantiles), how="left")  # one row each
    right = quantiles
    cond = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"_q_{k}")
        cond = cond & stats[k].eqNullSafe(F.col(f"_q_{k}"))
    return stats.join(right, cond, "left").drop(*[f"_q_{k}" for k in keys])
