import datetime as dt
import json

from pyspark.sql import functions as F

from barframe.session import scratch_path
from barframe.sources import scans, sinks, worklist
from barframe.streaming import feeds


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf8")
    return str(p)


def test_equity_file(spark, tmp_path):
    p = write(tmp_path, "sec_full_05012024.csv", "SYMBOL, SERIES, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, DELIV_PER\n"
              "AAA, EQ, 10, 11, 12, 9, 11.5, 100, 45.5\nBBB, BE, 10, 11, 12, 9, 11.5, 100, 45\nCCC, EQ, 10, -, 12, 9, 11.5, 100, 45\n"
              "DDD, EQ, 10, \"1,011\", 1012, 9, 11.5, 100, -\n")
    rows = {r.ticker: r for r in scans.equity_eod(spark, p).collect()}
    assert set(rows) == {"AAA", "DDD"} and rows["AAA"].date == dt.date(2024, 1, 5)
    assert rows["DDD"].open == 1011.0 and rows["DDD"].delivery_pct is None and rows["AAA"].volume == 100


def test_filing_archive_last_wins(spark):
    raw = spark.createDataFrame([
        ("A", None, None, "x", None, " t1 ", None, "05-Jan-2024 10:00:00", None, "7", 1), ("A", None, None, "x", None, "t2", None, "05-Jan-2024 11:00:00", None, "7", 2),
        ("B", None, None, "y", None, "t3", None, "bad", "06-Jan-2024 00:00:00", " ", 3), ("C", None, None, "y", None, "t", None, "bad", None, "9", 4)],
        scans.FILING_SCHEMA + ", o int")
    rows = {r.seq_id: r for r in scans.filing_archive(raw, F.col("o")).collect()}
    assert rows["nse:7"].attachment_text == "t2" and set(rows) == {"nse:7", "nse:B:2024-01-05T18:30:00.000Z:y"}


def test_derivatives_sentinels(spark, tmp_path):
    p = write(tmp_path, "fo.csv", "TradDt,TckrSymb,XpryDt,StrkPric,OptnTp,FinInstrmTp,ClsPric,TtlTradgVol\n2024-01-01,N,2024-01-25,,,IDF,100,5\n"
              "2024-01-01,N,2024-01-25,100,CE,IDO,3,0\n2024-01-01,N,2024-01-25,110,PE,IDO,3,7\n2024-01-01,N,2024-01-25,110,PE,IDO,3,7\n")
    rows = {(r.strike, r.option_type) for r in scans.derivatives_eod(spark, p).collect()}
    assert rows == {(-1.0, "FUT"), (110.0, "PE")}
    assert scans.derivatives_eod(spark, p, include_untraded=True).count() == 3


def test_insert_twice_is_idempotent(spark):
    at = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert sinks.insert_new(df, at, ["id"]).count() == 2
    assert sinks.insert_new(df.unionByName(spark.createDataFrame([(3, "c")], "id int, v string")), at, ["id"]).count() == 1
    assert sinks.read_inserted(spark, at).count() == 3


def test_partial_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "id int, a int, b int")
    new = spark.createDataFrame([(1, None, 9), (3, 1, None)], "id int, a int, b int")
    assert {tuple(r) for r in sinks.merged(old, new, ["id"]).collect()} == {(1, 5, 9), (2, 7, 8), (3, 1, None)}


def test_upsert_newest_first(spark):
    at = scratch_path(spark, "t")
    sinks.upsert(spark.createDataFrame([(1, 1, "old"), (2, 1, "x")], "id int, ts int, v string"), at, ["id"])
    sinks.upsert(spark.createDataFrame([(1, 2, "mid"), (1, 3, "new")], "id int, ts int, v string"), at, ["id"], [F.col("ts")])
    assert {(r.id, r.v) for r in sinks.read_table(spark, at).collect()} == {(1, "new"), (2, "x")}


def test_worklist(spark):
    days = worklist.day_windows(spark, "2024-01-05", "2024-01-09")
    assert [str(r.start) for r in days.orderBy("start").collect()] == ["2024-01-05", "2024-01-08", "2024-01-09"]
    spans = worklist.span_windows(spark, "2024-01-01", "2024-01-25", 10)
    assert {r.window_key for r in spans.collect()} == {"2024-01-01_2024-01-10", "2024-01-11_2024-01-20", "2024-01-21_2024-01-25"}
    assert [r.window_key for r in worklist.quarter_windows(spark, 2024, 2024).orderBy("start").collect()] == ["2024Q1", "2024Q2", "2024Q3", "2024Q4"]
    at = scratch_path(spark, "progress")
    rec = lambda k, s: spark.createDataFrame([("j", k, s, 1, None)], "job string, window_key string, status string, rows int, note string")
    worklist.checkpoint(rec("2024-01-05", "failed"), at)
    worklist.checkpoint(rec("2024-01-05", "done"), at)
    left = worklist.pending(days, worklist.checkpoint(rec("2024-01-08", "failed"), at), "j")
    assert {str(r.start) for r in left.collect()} == {"2024-01-08", "2024-01-09"}


def test_stream_restart_adds_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    item = lambda n, t: json.dumps(dict(item_no=n, source="rss", title=t, link=f"https://a.com/{n}", snippet="", published_at="2024-01-01T00:00:00Z"))
    (src / "a.json").write_text(item(1, "SUZLON order win: acquisition and merger approved by board") + "\n" + item(2, "Quite another story about rate cut by the bank"))
    ev, al, ck = (scratch_path(spark, x) for x in ("ev", "al", "ck"))
    run = lambda: feeds.poll_feeds(feeds.landed_items(spark, str(src)), ev, al, ck, as_of="2024-01-01 00:30:00", min_alert=5.0).awaitTermination()
    run()
    assert sinks.read_inserted(spark, ev).count() == 2 and sinks.read_inserted(spark, al).count() == 1
    (src / "b.json").write_text(item(1, "SUZLON order win: acquisition and merger approved by board"))
    run()
    assert sinks.read_inserted(spark, ev).count() == 2 and sinks.read_inserted(spark, al).count() == 1
