"""Replays, moments, defined winners and plans that were once wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barframe.operators import feed, options, screener
from barframe.session import scratch_path, shared_dir
from barframe.sources import sinks
from barframe.streaming import feeds

ITEMS = [
    (1, "rss", "HAL wins Rs 5,000 crore defence order from ministry", "https://a.com/1", "Letter of award received", dt.datetime(2020, 1, 1, 9)),
    (2, "rss", "Tata Motors quarterly results beat street estimates", "https://a.com/2", "board meeting outcome", dt.datetime(2020, 1, 1, 9, 5)),
]


def test_alerts_survive_a_failure_between_the_writes(spark, monkeypatch):
    src, events, alerts, ck = (scratch_path(spark, x) for x in ("src", "events", "alerts", "ck"))
    spark.createDataFrame(ITEMS, feeds.ITEM_SCHEMA).write.json(src)
    real, calls = feeds.insert_new, []

    def failing(df, table, *rest):
        calls.append(table)
        if table == alerts and calls.count(alerts) == 1:
            raise RuntimeError("lost between the writes")
        return real(df, table, *rest)

    monkeypatch.setattr(feeds, "insert_new", failing)
    run = lambda: feeds.poll_feeds(feeds.landed_items(spark, src), events, alerts, ck, as_of="2020-01-01 10:00:00", min_alert=1.0).awaitTermination()
    with pytest.raises(Exception):
        run()
    run()
    assert sinks.read_inserted(spark, events).count() == 2 and sinks.read_inserted(spark, alerts).count() == 2
    run()
    assert sinks.read_inserted(spark, events).count() == 2 and sinks.read_inserted(spark, alerts).count() == 2


def test_a_named_batch_is_written_once(spark):
    table = scratch_path(spark, "t")
    a = spark.createDataFrame([(1, "x"), (1, "w"), (2, "y")], "id int, v string")
    first = sinks.insert_new(a, table, ["id"], "epoch-0").collect()
    again = sinks.insert_new(a, table, ["id"], "epoch-0").collect()
    assert sorted(first) == sorted(again) == [(1, "w"), (2, "y")]
    assert sinks.insert_new(a.union(spark.createDataFrame([(3, "z")], a.schema)), table, ["id"], "epoch-1").collect() == [(3, "z")]


def test_first_per_key_is_defined(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 7, "0"), (2, None, None)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "k int, o int, v string").repartition(parts)
        assert sorted(sinks.first_per_key(df, ["k"], [F.col("o")]).collect()) == [(1, 5, "a"), (2, None, None)]
        assert sorted(sinks.first_per_key(df.select("k"), ["k"]).collect()) == [(1,), (2,)]


def test_nothing_after_as_of_is_seen(spark):
    day = dt.datetime(2020, 3, 10)
    rows = [("e1", "A", "old", 9.0, day - dt.timedelta(days=9)), ("e2", "A", "in time", 7.0, day - dt.timedelta(days=2)), ("e3", "A", "later", 10.0, day + dt.timedelta(hours=1))]
    ev = spark.createDataFrame(rows, "id string, ticker string, title string, impact_score double, published_at timestamp")
    assert [r.catalyst_event_id for r in screener.catalysts(ev, str(day)).collect()] == ["e2"]
    assert [r.id for r in feed.enrichment_worklist(ev.withColumn("ai_analysis", F.lit(None).cast("string")), str(day)).collect()] == ["e2"]
    assert [r.id for r in feeds.within_days(ev, str(day), 5).collect()] == ["e2"]


def test_volatility_is_solved_once(spark):
    chain = spark.createDataFrame(
        [("X", dt.date(2020, 1, 1), dt.date(2020, 2, 1), k, t, 100.0, p, 1000) for k in (95.0, 100.0, 105.0) for t, p in (("CE", 8.0), ("PE", 6.0))],
        "ticker string, trade_date date, expiry date, strike double, option_type string, underlying double, close double, volume long")
    plan = options.option_iv(chain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        shared_dir(Elsewhere())
