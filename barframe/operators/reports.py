"""Grouped outcome statistics shared by all studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.operators.quantiles import exact_quantiles, with_quantiles
from barframe.session import cut

THIN = 30


def win_pct(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lit(100.0) * F.avg(F.when(c > 0, 1.0).otherwise(0.0))


def outcome_report(
    df: DataFrame, keys: list[str], value: str, *, median: bool = True, extra: dict[str, Column] | None = None,
    medians: dict[str, str] | None = None, flag_thin: bool = False,
) -> DataFrame:
    """n, mean, median and win % of ``value`` per group, rows without a value left out."""
    rows = df.where(F.col(value).isNotNull())
    wanted = dict(medians or {})
    if median:
        wanted["median"] = value
    if wanted:
        # Quantiles read their input several times: keep the outcome columns, not the pipeline.
        rows = cut(rows, "outcomes")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), win_pct(value).alias("win_pct"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )
    for name, col in wanted.items():
        stats = with_quantiles(stats, exact_quantiles(rows, keys, col, {name: 0.5}), keys)
    return stats.withColumn("thin", F.col("n") < THIN) if flag_thin else stats


def tail_stats(df: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Tail view by the rank rule: n, mean, median, p01, p05, worst, win %."""
    rows = cut(df.where(F.col(value).isNotNull()), "outcomes")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("worst"),
        win_pct(value).alias("win_pct"), *[c.alias(k) for k, c in (extra or {}).items()],
    )
    q = exact_quantiles(rows, keys, value, {"p01": 0.01, "p05": 0.05, "median": 0.5}, method="rank")
    return with_quantiles(stats, q, keys)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def labelled_means(df: DataFrame, labels: list[tuple[str, Column]], measures: list[str], min_rows: int = 3) -> DataFrame:
    """Overlapping cells: each row counts in every cell whose predicate it meets."""
    cells = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in labels]))
    return (
        df.select(F.explode(cells).alias("cell"), *measures)
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])
        .where(F.col("n") >= min_rows)
    )


def load_audit(df: DataFrame, date_col: str, keys: list[str] | None = None) -> DataFrame:
    """Rows, distinct sessions and date range, overall or per key."""
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(date_col).alias("n_sessions"),
        F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
    )


def filled_share(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"filled_{c}") for c in cols])


def truncation_suspects(progress: DataFrame, limit: int = 9000) -> DataFrame:
    """Load windows so full that the source may have cut them."""
    return progress.where(F.col("rows") >= limit)


def mapping_coverage(names: DataFrame, mapping: DataFrame, key: str, map_key: str) -> DataFrame:
    """How many wanted names exist in a mapping table."""
    known = mapping.select(F.col(map_key).alias("_m")).distinct()
    return (
        names.select(key).distinct().join(known, F.col(key) == F.col("_m"), "left")
        .agg(F.count(F.lit(1)).alias("liquid"), F.count("_m").alias("mapped"))
    )


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; the smaller value wins ties. Two partial aggregations, no window."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.v").alias(value), (-F.col("b.neg")).alias("n")
    )


def weighted_shares(cands: DataFrame, regime: DataFrame, flag_cols: list[str], label_cols: list[str]) -> DataFrame:
    """Weighted share of each regime value over candidate sessions against the plain base rate.

    ``cands``: date, weight. The base is every regime day between the first and last
    candidate day that the regime table knows.
    """
    weights = cut(cands.groupBy("date").agg(F.sum("weight").alias("w")), "weights")  # a row a date, read twice
    j = regime.join(weights, "date")
    span = j.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    days = regime.join(F.broadcast(span), regime["date"].between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    days = days.join(weights, "date", "left")
    facets = F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))
        for c in flag_cols + label_cols
    ])
    cells = days.select("w", F.explode(facets).alias("f")).where("f.value is not null and f.value <> 'false'")
    tot = days.agg(F.sum("w").alias("_tw"), F.count(F.lit(1)).alias("_tn"))
    per = cells.groupBy(F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("_w"), F.count(F.lit(1)).alias("_n")
    )
    share = F.lit(100.0) * F.col("_w") / F.col("_tw")
    base = F.lit(100.0) * F.col("_n") / F.col("_tn")
    return per.join(F.broadcast(tot)).select(
        "facet", "value", share.alias("share_pct"), base.alias("base_pct"), (share / base).alias("lift")
    )


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    v, w = F.col(value), F.col(weight)
    return df.agg((F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))).alias(f"weighted_{value}"), F.avg(v).alias(f"mean_{value}"))


def profit_book(rows: DataFrame, keys: list[Column | str], pnl: str = "pnl") -> DataFrame:
    """Book shape: n, net, win %, gross profit and loss, profit factor."""
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, p).otherwise(0.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("net"), win_pct(p).alias("win_pct"),
        gain.alias("gross_profit"), loss.alias("gross_loss"),
        (gain / F.nullif(-loss, F.lit(0.0))).alias("profit_factor"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"),
    )
