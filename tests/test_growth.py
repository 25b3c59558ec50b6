"""Work that must not multiply: expressions taken once a row, tables shuffled once."""

import random
import re

from pyspark.sql import functions as F

from barframe.functions import extraction as X
from barframe.functions import text as T
from barframe.functions.numbers import parse_number
from barframe.operators import dedup, options, order_values, reports
from barframe.plans import q_options, q_sources, q_text
from barframe.plans.tables import Tables
from barframe.sources import scans


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_contract_symbols_are_taken_apart_once(spark):
    symbols = spark.createDataFrame([("ABC24JAN100CE", 1.0), ("ABC2412550.5PE", 2.0), ("ABC", 3.0)], "symbol string, buy double")
    listed = spark.createDataFrame([("ABC", "2024-01-25")], "ticker string, expiry string").withColumn("expiry", F.to_date("expiry"))
    out = options.contract_table(symbols, listed)
    assert plan(out).count("(JAN|FEB") <= 8  # one test and one look at each part
    got = {(r["symbol"], str(r["expiry"]), r["strike"], r["option_type"]) for r in out.collect()}
    assert got == {("ABC24JAN100CE", "2024-01-25", 100.0, "CE"), ("ABC2412550.5PE", "2024-01-25", 50.5, "PE")}


def test_chain_is_shuffled_only_by_instrument(spark, data_dir):
    rows = options.option_iv(Tables(spark, data_dir).chain, 300)
    assert plan(rows, "executedPlan").count("Exchange ") == 1


def test_forward_beside_rows_is_the_forward_of_the_day(spark, data_dir):
    chain = Tables(spark, data_dir).chain
    day = ["ticker", "trade_date", "expiry"]
    beside = options.with_forward(chain).select(*day, "forward").distinct()
    apart = options.implied_forwards(chain).select(*day, "forward")
    assert beside.exceptAll(apart).isEmpty() and apart.exceptAll(beside).isEmpty() and not apart.isEmpty()


def test_content_hash_builds_its_key_once(spark):
    df = spark.createDataFrame([("Hello, World", "http://Ab.com/x/"), ("", ""), ("\U0001f600 é", "x")], "title string, link string")
    out = df.select(T.content_hash("title", "link").alias("h"), T.content_key("title", "link").alias("k"))
    assert plan(df.select(T.content_hash("title", "link").alias("h"))).count("[^a-z0-9_]+") == 1

    def djb2(s):
        h = 5381
        for x in s:
            h = ((h * 33) ^ ord(x)) & 0xFFFFFFFF
        return format(h, "x")

    assert all(r["h"].lstrip("0") == djb2(r["k"]) for r in out.collect())
    assert spark.range(1).select(T.djb2_hex(F.lit("")).alias("h")).first()["h"] == "1505"


def test_contract_bars_are_unique_without_moving_rows(spark, tmp_path):
    row = lambda strike, close: f"2024-01-01,ABC,2024-01-25,{strike},CE,IDO,{close},{close},{close},{close},,,0,0,5,,1,1"
    head = "TradDt,TckrSymb,XpryDt,StrkPric,OptnTp,FinInstrmTp,OpnPric,HghPric,LwPric,ClsPric,SttlmPric,UndrlygPric,OpnIntrst,ChngInOpnIntrst,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd,NewBrdLotQty"
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("\n".join([head, row(100, 1), row(110, 2)]))
    two.write_text("\n".join([head, row(100, 1), row(110, 2), row(100, 1), row(110, 3)]))
    once = scans.derivatives_eod(spark, str(one))
    assert once.count() == 2 and "Exchange" not in plan(once, "executedPlan")
    assert sorted((r["strike"], r["close"]) for r in scans.derivatives_eod(spark, str(two)).collect()) == [(100.0, 1.0), (110.0, 2.0)]


def test_surface_of_points_and_ties(spark):
    rows = [("A", e, k, kind, 0.2 + k / 1000 + n / 10, d) for e, n in (("2024-01-25", 0), ("2024-02-29", 1)) for k, kind, d in (
        (90.0, "CE", 0.8), (90.0, "PE", -0.2), (100.0, "CE", 0.5), (100.0, "PE", -0.5), (110.0, "CE", 0.2), (110.0, "PE", -0.8), (115.0, "CE", 0.2))]
    iv = spark.createDataFrame(rows, "ticker string, expiry string, strike double, option_type string, iv double, delta double").selectExpr(
        "ticker", "date'2024-01-02' trade_date", "cast(expiry as date) expiry", "strike", "option_type", "iv", "delta", "105.0D forward", "104.0D underlying")
    got = options.daily_surface(iv).collect()
    assert len(got) == 1 and got[0]["n_strikes"] == 4
    put = 0.29 + (0.3 - 0.29) / (-0.5 + 0.2) * (-0.25 + 0.2)
    call = (0.31 + 0.315) / 2 + (0.3 - (0.31 + 0.315) / 2) / (0.5 - 0.2) * (0.25 - 0.2)
    want = {"atm_iv": 0.305, "next_atm_iv": 0.405, "term_slope": 0.1, "skew_25d": put - call}
    assert all(abs(got[0][k] - v) < 1e-12 for k, v in want.items())


def test_sectors_are_counted_once(spark):
    df = spark.createDataFrame([("",)], "low string").withColumn("h", X.keyword_hits(F.col("low")))
    assert plan(df.select(X.primary_sector(F.col("h")).alias("s"))).count("category") < 10
    assert df.select(X.primary_sector(F.col("h")).alias("s")).first()["s"] is None


def test_every_pattern_has_its_words():
    assert len(X.KIND_WORDS) == len(X.CONTRACT_KINDS) and len(X.VALUE_WORDS) == len(X.ORDER_VALUES)


def test_small_polls_are_walked_and_both_ways_agree(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("rounds for a small poll")

    base = "Reliance Industries wins crore solar order from SECI"
    rows = [(i, f"{base} {'x' * (i % 17)}{i % 3}" if i % 4 else ["HAL order", "abcdefghijklmnopqrst"[: 14 + i % 6], "", None][i // 4 % 4],
             None if i % 10 == 9 else f"https://a.com/{i * 7 % 23}", None if i % 5 == 4 else i % 5) for i in range(60)]
    items = spark.createDataFrame(rows, "n long, title string, link string, poll long")
    decided = lambda by: sorted(r["n"] for r in dedup.deduplicate(items, order="n", batch=by).collect())
    with monkeypatch.context() as m:
        m.setattr(dedup, "_resolve", rounds)
        walked = [decided(["poll"]), decided(None)]
    monkeypatch.setattr(dedup, "WALKED", 3)
    assert walked == [decided(["poll"]), decided(None)]
    # No title and no link is like nothing else, also where the poll has no name.
    lone = spark.createDataFrame([(1, None, None, None), (2, None, None, None)], items.schema)
    assert dedup.deduplicate(lone, order="n", batch=["poll"]).count() == 2


def test_equal_texts_are_read_once_for_order_values(spark, monkeypatch):
    texts = ["Company bags order worth Rs 120 crore", "Order book stands at Rs 5 lakh; contract value US$ 7 mn", "nothing", "", None]
    df = spark.createDataFrame([(i, f"S{i}", texts[i % 5]) for i in range(40)], "seq_id long, symbol string, body string")
    want = sorted(order_values.order_values(df, "seq_id", "body").collect())
    real, read = order_values.order_values, []
    monkeypatch.setattr(order_values, "order_values", lambda t, *rest: read.append(t.count()) or real(t, *rest))
    got = order_values.order_values_of_repeats(df, "seq_id", "body")
    assert sorted(got.collect()) == want and len(want) == 40 and read == [4]
    summary = order_values.confidence_summary(got.where("seq_id % 77 < 76"))
    assert "% 77" not in plan(summary) and sum(r["n"] for r in summary.collect()) == 40


def test_weights_of_fills_are_made_once(spark, data_dir):
    t = Tables(spark, data_dir)
    got = {r["date"]: r["weight"] for r in options.fill_session_weights(t.contracts, t.chain).collect()}
    want = {r["date"]: r["weight"] for r in options.candidate_session_weights(options.resolve_fills(t.contracts, t.chain), t.chain).collect()}
    assert got.keys() == want.keys() and got and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    regime = spark.sql("select date_add(date'2020-01-01', cast(id as int)) date, id % 2 = 0 e, 'x' d from range(9)")
    cands = regime.where("day(date) % 77 < 76").selectExpr("date", "1.0D weight")
    shares = reports.weighted_shares(cands, regime, ["e"], ["d"])
    assert "% 77" not in plan(shares) and shares.count() == 2


def test_a_buyer_report_runs_its_outcomes_once(spark):
    rows = spark.sql("select cast(id % 3 as string) b, id + 1.0D close, id - 4.0D gross, id - 5.0D net from range(12) where id % 77 < 76")
    block = options.buyer_block(rows, "b")
    assert "% 77" not in plan(block)
    assert sorted((r["b"], r["n"], r["median_premium"]) for r in block.collect()) == [("0", 4, 5.5), ("1", 4, 6.5), ("2", 4, 7.5)]


def test_a_number_is_looked_for_once(spark):
    shown = [" 1,234.50 ", "-", "", None, "+.5x", "1e3", "-7 Cr", "NaN", "Infinity", "1d", "0x1p3", ".", "12abc34", "1e999"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shown)], "i int, s string")
    out = df.select("i", parse_number("s").alias("v"))
    assert plan(out).count("regexp_extract") == 1
    assert [r["v"] for r in out.orderBy("i").collect()] == [1234.5, None, None, None, 0.5, 1000.0, -7.0, None, None, 1.0, 0.0, None, 12.0, float("inf")]


def test_surface_and_its_ranks_are_shuffled_twice(spark, data_dir):
    t = Tables(spark, data_dir)
    ranked = options.surface_ranks(options.daily_surface(options.option_iv(t.chain, 300)))
    assert plan(ranked, "executedPlan").count("Exchange ") == 2  # bars by instrument, and rows by instrument behind the root finder


def test_fills_meet_the_chain_without_sending_it_round(spark, data_dir):
    t = Tables(spark, data_dir)
    for met in (options.resolve_fills(q_options.undated(t), t.chain), options.fill_session_weights(q_options.undated(t), t.chain)):
        shown = plan(met, "executedPlan")
        assert "Join" not in shown and "Broadcast" not in shown  # the chain is far larger than a planner takes it for
    assert plan(options.resolve_fills(q_options.undated(t), t.chain), "executedPlan").count("Exchange ") == 2  # fills and bars, by instrument


def test_fills_without_a_contract_or_sessions_and_several_of_one(spark):
    bars = spark.sql("""select * from values (date'2024-01-01', 'A', date'2024-01-25', 100.0D, 'CE', 1.0D, 2.0D), (date'2024-01-02', 'A', date'2024-01-25', 100.0D, 'CE', 3.0D, 4.0D),
        (date'2024-01-02', 'A', null, 100.0D, 'CE', 1.0D, 9.0D) as b(trade_date, ticker, expiry, strike, option_type, low, high)""")
    rows = [(1, "A", "2024-01-25", 100.0, 1.5, 3.5), (2, "A", "2024-01-25", 100.0, 3.5, 1.5), (3, "A", "2024-01-25", 110.0, 1.5, 3.5),
            (4, "A", None, 100.0, 1.5, 3.5), (5, "A", None, 100.0, 1.5, 3.5), (6, "A", "2024-01-25", 100.0, 0.0, 3.5), (7, None, None, None, None, None)]
    fills = spark.createDataFrame([(*r, 1.0) for r in rows], "fill_id int, ticker string, expiry string, strike double, buy double, sell double, pnl double").selectExpr(
        "fill_id", "ticker", "cast(expiry as date) expiry", "strike", "'CE' option_type", "buy", "sell", "pnl")
    resolved = options.resolve_fills(fills, bars)
    got = {r["fill_id"]: (r["status"], r["side"], r["n_buy"], r["n_sell"]) for r in resolved.collect()}
    assert got == {1: ("resolved", "LONG", 1, 1), 2: ("resolved", "SHORT", 1, 1), 3: ("no_bars", None, 0, 0), 4: ("no_contract", None, 0, 0),
                   5: ("no_contract", None, 0, 0), 6: ("settled", "SHORT", 0, 1), 7: ("no_contract", None, 0, 0)}
    weights = {str(r["date"]): r["weight"] for r in options.fill_session_weights(fills, bars).collect()}
    assert weights == {"2024-01-01": 1.0, "2024-01-02": 2.0}
    assert weights == {str(r["date"]): r["weight"] for r in options.candidate_session_weights(resolved, bars).collect()}


def test_similar_titles_are_those_of_the_plain_distance():
    rng = random.Random(4)
    words = ["order", "solar", "crore", "wins", "reliance", "a", "of", "the", "seci", "ntpc", "2024", "metro"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 12, 26]))) for _ in range(60)]
    titles += [t[: rng.randrange(len(t) + 1)] + rng.choice(["", "x", "zz top"]) for t in titles] + ["", "ab" * 40, "ab" * 44, "a" * 64, "a" * 65, "a" * 128, "\0AB"]
    titles = list(dict.fromkeys(titles))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a in titles for b in titles if max(len(a), len(b)) >= 20 and distance(a, b) / max(len(a), len(b)) <= 0.3}
    assert {(titles[i], titles[j]) for i, j in dedup._similar(titles, titles)} == want and len(want) > 80


def test_a_large_poll_is_compared_in_blocks_and_never_in_one_row(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 64)
    monkeypatch.setattr(dedup, "_walk", lambda polls, keys: polls.where("false").select(*keys, F.lit(0).cast("long").alias("ord")))
    items = spark.range(600).selectExpr("id n", "concat(substr(sha2(cast(id div 2 as string), 256), 1, 40), id % 2) title", "concat('https://a.com/', id) link")
    assert sorted(r["n"] for r in dedup.deduplicate(items, order="n").collect()) == list(range(0, 600, 2))
    titles = items.selectExpr("'p' _poll", "n id", "title")
    pairs = dedup.similar_pairs(titles)
    assert {(r["tx"], r["ty"]) for r in pairs.collect()} == {(i, i ^ 1) for i in range(600)}
    assert pairs.rdd.getNumPartitions() > 55  # ten blocks, each with each


def test_needles_of_a_score_are_counted_once(spark):
    rows = [(["order win", "Takeover", "5G", "final dividend"], ["a", "b", "c"]), ([], []), (None, None), (["USFDA approval", None, "AI"], ["a"])]
    df = spark.createDataFrame(rows, "k array<string>, t array<string>").select(
        X.impact_score(F.col("k"), F.col("t"), F.lit(700.0), F.lit("Cr"), F.lit("2020-01-01 00:00:00").cast("timestamp"), F.lit("2020-01-01 02:00:00").cast("timestamp")).alias("s"))
    assert plan(df).count("promoter buying") == 1
    got = [(r["s"]["total_score"], r["s"]["keyword_score"], r["s"]["sector_score"], r["s"]["recency_score"], r["s"]["order_value_score"]) for r in df.collect()]
    assert got == [(8.0, 0.9, 0.65, 0.9, 0.7), (5.4, 0.3, 0.3, 0.9, 0.7), (5.4, 0.3, 0.3, 0.9, 0.7), (6.5, 0.5, 0.55, 0.9, 0.7)]


def test_a_company_is_looked_for_where_one_can_be(spark):
    shown = ["Bharat Forge Ltd. wins", "Tata Motors  Limited", "abc Infra", "A & B Pharma", "Zen Technologies", "nothing Here", "X Corporation", "LTD Ltd", "", None, "Apar Industries Limited; more"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shown)], "i int, s string")
    plain = F.nullif(F.regexp_replace(F.regexp_extract("s", X.COMPANY, 1), f"^{X._WS}+|{X._WS}+$", ""), F.lit(""))
    out = df.select("i", X.company_name(F.col("s")).alias("a"), plain.alias("b")).orderBy("i").collect()
    assert [r["a"] for r in out] == [r["b"] for r in out] and out[0]["a"] == "Bharat Forge Ltd." and out[5]["a"] is None
    kinds = X.COMPANY.split("(?:")[1].replace(")", "").replace(r"\.?", "").split("|")
    assert all(any(w in k for w in X.COMPANY_WORDS) for k in kinds)


def test_reads_of_new_events_store_nothing_and_read_only_the_texts_they_need(spark, data_dir):
    t = Tables(spark, data_dir)
    digest = plan(q_text.feed.alert_digest(t.fresh_events(), 4.2).select("id", "impact_score", "ticker", "headline", "link"))
    assert "Technologies" not in digest and "turnkey" not in digest.replace("turnkey order", "")
    when = "1999-06-10 00:00:00"
    window = q_text.within_days(t.items, when, q_text.feed.ENRICH_DAYS)
    want = t.events.where(F.col("published_at").between(F.lit("1999-06-07").cast("timestamp"), F.lit(when).cast("timestamp"))).select("id", "impact_score")
    got = t.fresh_events(window).select("id", "impact_score")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty() and not got.isEmpty()


def test_money_is_looked_for_once_a_text_and_not_once_a_mention(spark):
    text = "Order worth Rs. 12 crore; " + "x" * 400 + " revenue of INR 5 lakh, value in crores of 7.5 " * 3
    df = spark.createDataFrame([(1, text), (2, "no money"), (3, None), (4, "Rs 1 crore Rs 2 crore")], "k int, t string")
    out = order_values.money_mentions(df, "k", "t")
    shown = plan(out)
    assert shown.count("regexp_extract_all(") == 2 and shown.count("split(") == 2
    rows = sorted((r["k"], r["unit_first"], r["pos"], r["num"], r["unit"]) for r in out.collect())
    assert [r[3:] for r in rows if r[0] == 4] == [("1", "crore"), ("2", "crore")]
    assert [(r[2], *r[3:]) for r in rows if r[0] == 1 and not r[1]][0] == (text.index("Rs. 12"), "12", "crore")
    assert [r[2] for r in rows if r[0] == 1 and r[1]] == [m.start() for m in re.finditer("value in crores", text)]


def test_landed_contracts_are_packed_quickly(spark, data_dir, tmp_path, monkeypatch):
    used = {}
    monkeypatch.setattr(q_sources, "land", lambda t, df, fmt, **options: used.update(options) or str(tmp_path / "a"))
    monkeypatch.setattr(q_sources.scans, "derivatives_eod", lambda spark, path: spark.range(1))
    q_sources.query.__globals__["REGISTRY"]["scan_derivatives"].run(spark, data_dir)
    rows = spark.range(20000).selectExpr("cast(hash(id) as string) a", "cast(id as string) b").coalesce(1)
    size = lambda name, **options: rows.write.options(**options).csv(str(tmp_path / name)) or sum(f.stat().st_size for f in (tmp_path / name).glob("*.gz"))
    assert size("quick", **used) > size("plain", compression="gzip") > 0  # the level reaches the codec
