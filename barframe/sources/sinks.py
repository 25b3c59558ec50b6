"""Keyed sinks on partitioned Parquet tables.

A key decides the partition of its row: by a date in it where there is one, else by a bucket of its
hash. A write reads only the partitions that its keys fall into and replaces them (or adds to them)
by Spark's dynamic partition overwrite; files of other partitions are neither read nor touched, so
the work follows the batch and not the history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.session import cut, steps

c = F.col
#: Partition columns of a stored table: where the key belongs, and which batch wrote a row (insert-only tables).
PART, BATCH = "part_", "batch_"
BUCKETS = 16


def _part(keys: list[str], by: Column | None) -> Column:
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if by is None else by
    return F.coalesce(bucket.cast("string"), F.lit("none"))


def _exists(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _stored(spark: SparkSession, table: str, columns: T.StructType | None, *more: str) -> DataFrame | None:
    """The table with its partition columns; by ``columns`` if given, else as its files have them."""
    if not _exists(spark, table):
        return None
    if columns is None:
        return spark.read.option("mergeSchema", True).parquet(table)
    partitions = [T.StructField(m, T.StringType()) for m in more]
    return spark.read.schema(T.StructType([*columns.fields, *partitions])).parquet(table)


def _write(df: DataFrame, table: str, *by: str) -> None:
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)


def _touched(df: DataFrame) -> list[str]:
    """The partitions of a batch; far fewer than its rows."""
    return [r[PART] for r in df.select(PART).distinct().collect()]


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    stored = _stored(spark, table, None)
    return None if stored is None else stored.drop(PART, BATCH)


def rebuild(df: DataFrame, table: str, by: list[str] | None = None) -> DataFrame:
    """Replace the whole table by a query's result (create-table-as), partitioned by ``by``.

    The result is complete in the shared folder before the old table goes, so it may be made of that table.
    """
    with steps(df.sparkSession):
        writer = cut(df, "rebuild").write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*by) if by else writer).parquet(table)
    return df.sparkSession.read.schema(df.schema).parquet(table)


def newest_per_key(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The row with the greatest rank per key, by aggregation (map-side combine), not by a window."""
    body = [x for x in df.columns if x not in keys]
    order = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(rank)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*body), order).alias("r")).select(*keys, "r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key, the first by ``order``; ties, and no order at all, are settled by the rows' own content.

    A retried task so keeps the same row.
    """
    body = [x for x in df.columns if x not in keys]
    if not body:
        return df.distinct()
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or [])], F.to_json(F.struct(*body)).alias("content"))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*body), rank).alias("r")).select(*keys, "r.*").select(*df.columns)


def mostly_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``first_per_key`` of a scan whose keys hardly ever repeat, without shuffling its rows.

    Hashes of the keys are counted first; only rows whose hash is met twice are put together by key. The
    count is run, and the few hashes are written, when the function is called.
    """
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    twice = cut(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "met-twice")
    if twice.isEmpty():
        return df
    once = hashed.join(twice, "_h", "left_anti").drop("_h")
    return once.unionByName(first_per_key(hashed.join(twice, "_h", "left_semi").drop("_h"), keys))


def new_rows(df: DataFrame, table: str, keys: list[str], batch: str, by: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """The rows of ``df`` whose key no other batch of the table holds, with their partition; only the partitions of its keys are read."""
    fresh = first_per_key(df, keys, order).withColumn(PART, _part(keys, by))
    stored = _stored(df.sparkSession, table, df.select(*keys).schema, PART, BATCH)
    if stored is None:
        return fresh
    known = stored.where(c(PART).isin(_touched(df.select(*keys).withColumn(PART, _part(keys, by)))) & (c(BATCH) != batch))
    return fresh.join(known.select(*keys), keys, "left_anti")


def insert_new(
    df: DataFrame, table: str, keys: list[str], batch_id: str | None = None, order: list[Column] | None = None, by: Column | None = None,
) -> DataFrame:
    """Insert rows whose key is absent; returns exactly the rows that were new, as they are stored.

    ``by`` is made of key columns and names the partition. A batch that is written again under its
    ``batch_id`` finds the same new rows and replaces its own files, so a replay changes nothing.
    """
    spark, batch = df.sparkSession, batch_id or uuid.uuid4().hex
    _write(new_rows(df, table, keys, batch, by, order).withColumn(BATCH, F.lit(batch)), table, PART, BATCH)
    return _stored(spark, table, df.schema, PART, BATCH).where(c(BATCH) == batch).drop(PART, BATCH)


def read_inserted(spark: SparkSession, table: str) -> DataFrame:
    return read_table(spark, table)


def _replaced(df: DataFrame, table: str, keys: list[str], by: Column | None, join) -> DataFrame:
    """Write ``join(old, new)`` over the partitions that the keys of ``df`` fall into; ``old`` holds just their rows."""
    spark = df.sparkSession
    new = df.withColumn(PART, _part(keys, by))
    stored = _stored(spark, table, None)
    with steps(spark):
        if stored is not None:
            # Complete in the shared folder before the partitions it is made of are replaced.
            old = stored.withColumn(PART, c(PART).cast("string")).where(c(PART).isin(_touched(new)))
            new = cut(join(old, new), "upsert")
        _write(new, table, PART)
    return read_table(spark, table)


def upsert(df: DataFrame, table: str, keys: list[str], newest: list[Column] | None = None, by: Column | None = None) -> DataFrame:
    """Insert or update on key. ``newest``: rank inside ``df`` when a key repeats (greatest wins)."""
    new = newest_per_key(df, keys, newest) if newest else first_per_key(df, keys)
    return _replaced(new, table, keys, by, lambda old, n: n.unionByName(old.join(n.select(*keys), keys, "left_anti"), allowMissingColumns=True))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Column-wise upsert: a NULL in the new row leaves the old value alone."""
    cols = [x for x in dict.fromkeys(old.columns + new.columns) if x not in keys]
    n = new.select(*keys, *[c(x).alias(f"_n_{x}") for x in new.columns if x not in keys])
    j = old.join(n, keys, "full_outer")
    pick = lambda x: F.coalesce(*[c(p) for p in ([f"_n_{x}"] if x in new.columns else []) + ([x] if x in old.columns else [])])
    return j.select(*keys, *[pick(x).alias(x) for x in cols])


def upsert_columns(df: DataFrame, table: str, keys: list[str], by: Column | None = None) -> DataFrame:
    """Insert or update on key, column by column: NULLs of ``df`` and columns it lacks leave the stored values."""
    return _replaced(df, table, keys, by, lambda old, new: merged(old, new, [*keys, PART]))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``; all others stay.

    Rows are gathered by partition first, so that a partition is a few files and not one of every task;
    a large partition is split by size.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
