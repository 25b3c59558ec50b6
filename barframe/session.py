"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Trade dates and instants are handled as UTC instants; exchange-local time is derived.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Non-ANSI: a bad cast is a NULL, as a loader that keeps going expects.
    "spark.sql.ansi.enabled": "false",
}
# Only a new session can take these. Call-site capture costs two JVM round trips per
# expression, and wide plans have thousands of expressions.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "barframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    A private folder is made only in local mode (tests), where one machine is all there is; on a cluster
    without the setting this is an error, since files of one machine are not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-barframe-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/barframe/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a small scan over all cores, for work that is heavy per row.

    A large table already has more splits than cores and is returned as it is: no shuffle.
    Meant for plain scans, whose partition count is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Tables written since the innermost ``settle`` or ``steps`` began.
_STEPS: ContextVar[tuple[str, ...]] = ContextVar("barframe_steps", default=())


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table in the shared folder (survives executor loss).

    The table stays until the ``settle`` or ``steps`` around it ends, or for good if there is none.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    _STEPS.set((*_STEPS.get(), path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end, also if it fails."""
    around = _STEPS.get()
    _STEPS.set(())
    try:
        yield
    finally:
        for path in _STEPS.get():
            delete(spark, path)
        _STEPS.set(around)


def settle(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write what ``build`` returns, and delete the tables that were cut for it.

    What is returned depends on its own table only; that one belongs to the ``settle`` or ``steps`` around, if any.
    """
    path = scratch_path(spark, label)
    with steps(spark):
        result = build()
        result.write.mode("overwrite").parquet(path)
    _STEPS.set((*_STEPS.get(), path))
    return spark.read.schema(result.schema).parquet(path)
