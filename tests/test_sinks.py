"""Sinks touch only the partitions that their keys fall into."""

import os

from pyspark.sql import functions as F

from barframe.session import cut, scratch_path, settle, shared_dir, steps
from barframe.sources import sinks

BARS = "ticker string, day string, px double, note string"


def bars(spark, days, px=1.0, note="a"):
    return spark.createDataFrame([(t, d, px, note) for d in days for t in ("A", "B", "C")], BARS)


def files(path):
    path = path.replace("file:", "")
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_insert_reads_only_the_partitions_of_its_keys(spark):
    at = scratch_path(spark, "bars")
    days = [f"2020-01-{k:02d}" for k in range(1, 8)]
    for d in days:
        assert sinks.insert_new(bars(spark, [d]), at, ["ticker", "day"], f"b-{d}", by=F.col("day")).count() == 3
    before = files(at)
    fresh = sinks.new_rows(bars(spark, ["2020-01-07", "2020-01-08"]), at, ["ticker", "day"], "next", F.col("day"))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    scan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert "2020-01-07" in plan and "2020-01-01" not in scan
    assert len(sinks._stored(spark, at, fresh.select("ticker", "day").schema, sinks.PART, sinks.BATCH).where(F.col(sinks.PART).isin(["2020-01-07"])).inputFiles()) <= len(before)
    got = sinks.insert_new(bars(spark, ["2020-01-07", "2020-01-08"]), at, ["ticker", "day"], "next", by=F.col("day")).collect()
    assert {r.day for r in got} == {"2020-01-08"} and len(got) == 3
    assert before.items() <= files(at).items()  # nothing that was there is written again
    assert sinks.read_inserted(spark, at).count() == 24 and sinks.read_inserted(spark, at).columns == ["ticker", "day", "px", "note"]


def test_a_replay_replaces_its_own_rows_only(spark):
    at = scratch_path(spark, "replay")
    sinks.insert_new(bars(spark, ["d1"]), at, ["ticker", "day"], "e0")
    first = sinks.insert_new(bars(spark, ["d1", "d2"]), at, ["ticker", "day"], "e1").collect()
    again = sinks.insert_new(bars(spark, ["d1", "d2"]), at, ["ticker", "day"], "e1").collect()
    assert sorted(first) == sorted(again) and {r.day for r in first} == {"d2"} and sinks.read_inserted(spark, at).count() == 6
    assert sinks.insert_new(bars(spark, ["d1"]), at, ["ticker", "day"], "e2").count() == 0


def test_an_upsert_leaves_other_partitions_alone(spark):
    at = scratch_path(spark, "upsert")
    sinks.upsert(bars(spark, ["d1", "d2", "d3"]), at, ["ticker", "day"], by=F.col("day"))
    before = files(at)
    sinks.upsert(bars(spark, ["d2"], 5.0).where("ticker <> 'C'"), at, ["ticker", "day"], by=F.col("day"))
    after = files(at)
    kept = {f for f in before if "part_=d2" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept) and not {f for f in before if "part_=d2" in f} & set(after)
    assert {(r.ticker, r.day): r.px for r in sinks.read_table(spark, at).collect()} == {
        (t, d): 5.0 if d == "d2" and t != "C" else 1.0 for t in "ABC" for d in ("d1", "d2", "d3")}
    sinks.upsert_columns(spark.createDataFrame([("A", "d3", None, "b"), ("Z", "d3", 2.0, None)], BARS), at, ["ticker", "day"], by=F.col("day"))
    got = {(r.ticker, r.day): (r.px, r.note) for r in sinks.read_table(spark, at).collect()}
    assert got["A", "d3"] == (1.0, "b") and got["Z", "d3"] == (2.0, None) and len(got) == 10


def test_rebuild_may_read_what_it_replaces(spark):
    at = scratch_path(spark, "rebuild")
    sinks.rebuild(bars(spark, ["d1", "d2"]), at, ["day"])
    out = sinks.rebuild(spark.read.parquet(at).where("day = 'd2'").select("ticker", F.col("day").cast("string").alias("day"), "px", "note"), at, ["day"])
    assert out.count() == 3 and spark.read.parquet(at).count() == 3


def test_steps_are_deleted_and_results_stay(spark):
    seen = []

    def build():
        seen.append(cut(spark.range(5), "inner"))
        return seen[0].selectExpr("id * 2 as id")

    folder = shared_dir(spark).replace("file:", "") + "/barframe"
    with steps(spark):
        out = settle(spark, build, "outer")
        names = os.listdir(folder)
        assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
        assert any(n.startswith("outer-") for n in names) and not any(n.startswith("inner-") for n in names)
    assert not any(n.startswith("outer-") for n in os.listdir(folder))
