import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barframe.functions import options_math as M
from barframe.operators import adjust, indicators, ledger, options, quantiles, regime, sessions, smoothing, waves
from barframe.operators.asof import join_nearest

DAY0 = dt.date(2020, 1, 1)


def bars(spark, closes, spread=0.0, volume=1000, ticker="A", ohlc=None):
    rows = []
    for i, x in enumerate(closes):
        o, h, l, cl = ohlc[i] if ohlc else (x, x + spread, x - spread, x)
        rows.append((ticker, DAY0 + dt.timedelta(days=i), float(o), float(h), float(l), float(cl), int(volume)))
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")
    return df.withColumn("close_raw", F.col("close"))


def last(df, col):
    return df.orderBy(F.desc("date")).first()[col]


def test_small_series(spark):
    b = bars(spark, [1, 2, 3, 4, 5])
    assert last(b.withColumn("x", indicators.sma("close", 5)), "x") == 3
    assert last(b.withColumn("x", indicators.sma("close", 2)), "x") == 4.5
    assert last(indicators.with_ema(b, 3, "x"), "x") == pytest.approx(4, abs=1e-12)
    assert last(indicators.with_ema(bars(spark, [1, 2]), 5, "x"), "x") is None
    assert last(indicators.with_ema(bars(spark, [100] * 50), 20, "x"), "x") == pytest.approx(100, abs=1e-10)


def test_rsi(spark):
    classic = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.1, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28]
    rsi = lambda xs: last(indicators.with_rsi(bars(spark, xs), 14, "x"), "x")
    assert rsi(classic) == pytest.approx(70.46, abs=0.06)
    assert rsi([100 + i for i in range(20)]) == 100
    assert rsi([100 - i for i in range(20)]) == 0
    assert rsi([100] * 20) == 50
    assert rsi([1] * 14) is None


def test_atr(spark):
    atr = lambda b: last(indicators.with_atr(b), "atr14")
    assert atr(bars(spark, [100] * 30, 1)) == pytest.approx(2, abs=1e-10)
    assert atr(bars(spark, [100] * 15 + [110])) == pytest.approx(10 / 14, abs=1e-10)
    assert atr(bars(spark, [100] * 14, 1)) is None


def test_smoothing_over_many_blocks(spark):
    rnd = random.Random(3)
    xs = [rnd.uniform(1, 100) for _ in range(400)]
    df = bars(spark, xs)
    # Fast decay makes short blocks legitimate: q^60 is below double precision.
    out = smoothing._smooth_group(df, [smoothing.Smoother("close", 2, 0.5, "x")], 60, "ticker", "date")
    e, want = None, []
    for i, x in enumerate(xs):
        e = None if i < 1 else (xs[0] + xs[1]) / 2 if i == 1 else e * 0.5 + x * 0.5
        want.append(e)
    got = [r.x for r in out.orderBy("date").collect()]
    assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], want[1:]))


def test_block_lengths_are_safe():
    for size, group in smoothing.block_groups([smoothing.ema("c", p, f"e{p}") for p in (3, 20, 50, 200)] + [smoothing.wilder("c", p, f"w{p}") for p in (2, 7, 14)]):
        for s in group:
            assert size * s.decay < 700 and size > s.period
            assert size * s.decay >= smoothing._FADED


def test_snapshot_fields(spark):
    short = indicators.latest_snapshot(bars(spark, [100, 101], 1)).first()
    assert short.ema200 is None and short.rsi14 is None and short.pct_from_52w_high is not None and short.weekly_trend == "FLAT"
    long = indicators.latest_snapshot(bars(spark, [100 + math.sin(i / 10) * 5 for i in range(300)], 1)).first()
    assert all(long[x] is not None for x in indicators.INDICATORS)


def test_pct_from_high(spark):
    b = bars(spark, [0] * 3, ohlc=[(100, 100, 100, 100), (100, 100, 100, 100), (90, 90, 90, 90)])
    assert last(b.withColumn("x", indicators.pct_from_high()), "x") == pytest.approx(-10)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    vals = [round(rnd.gauss(0, 1), 2) if i % 3 else 0.0 for i in range(n)]  # a third of all rows share one value
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    ps = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "z": 1.0, "y": 0.0}
    # A coarse sketch: its cut points are far off, the answer is not.
    got = quantiles.exact_quantiles(df, ["k"], "v", ps, grid=4, accuracy=3).first()
    s = sorted(vals)
    for name, p in ps.items():
        at = p * (n - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        assert got[name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), abs=1e-12)
    got = quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5}, method="rank", grid=4, accuracy=3).first()
    assert (got.a, got.b) == (s[min(n - 1, math.floor(0.05 * n))], s[min(n - 1, math.floor(0.5 * n))])


def test_asof_directions(spark):
    b = bars(spark, [1, 2, 3]).where("close <> 2")  # days 0 and 2
    p = spark.createDataFrame([(i, "A", DAY0 + dt.timedelta(days=d)) for i, d in enumerate((-5, 0, 1, 2))], "i int, k string, d date")
    def hit(**kw):
        out = join_nearest(p, b, probe_key="k", probe_date="d", payload=["close"], how="left", **kw)
        return {r.i: r.close for r in out.collect()}
    assert hit(direction="forward", strict=True) == {0: 1.0, 1: 3.0, 2: 3.0, 3: None}
    assert hit(direction="forward", strict=False) == {0: 1.0, 1: 1.0, 2: 3.0, 3: 3.0}
    assert hit(direction="backward", strict=True) == {0: None, 1: None, 2: 1.0, 3: 1.0}
    assert hit(direction="backward", strict=False) == {0: None, 1: 1.0, 2: 1.0, 3: 3.0}


def test_planted_waves(spark):
    # up, up, up, inside bar -> signal; then a direct reversal without a signal.
    hl = [(10, 8), (11, 9), (12, 10), (13, 11), (12.5, 11.5), (14, 12), (15, 13), (16, 14), (15, 13), (14, 12), (14, 12)]
    b = bars(spark, [0] * len(hl), ohlc=[(l + 0.5, h, l, h - 0.5) for h, l in hl])
    rows = waves.wave_signals(b, min_len=3, min_bars=1).orderBy("signal_date").collect()
    assert [(r.signal_date, r.wave_dir, r.wave_len, r.direction) for r in rows] == [(DAY0 + dt.timedelta(days=4), "up", 3, "short")]
    r = rows[0]
    assert r.wave_move_pct == pytest.approx((12.5 - 9.5) / 9.5 * 100) and r.body_ratio == pytest.approx(0.0)
    assert r.start_gap_pct == pytest.approx(0.0) and r.prior_gap_pct is None


def test_adjustment_closes_the_gap(spark):
    raw = bars(spark, [100] * 5 + [50] * 5).drop("close_raw")
    acts = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=4), "Bonus 1:1", 0.5)], "ticker string, ex_date date, subject string, adj_factor double")
    loc = adjust.with_effective_dates(acts, adjust.detect_effective_dates(acts, raw))
    row = loc.first()
    assert row.effective_date == DAY0 + dt.timedelta(days=5) and row.detection_note == "matched ratio 0.5000 vs expected 0.5000"
    adj = adjust.back_adjust(raw, loc)
    assert {r.close for r in adj.collect()} == {50.0} and {r.close_raw for r in adj.collect()} == {100.0, 50.0}
    audit = adjust.adjustment_audit(adj, loc).first()
    assert (audit.raw_gap_pct, audit.adj_gap_pct, audit.suspicious) == (-50.0, 0.0, False)


def test_entry_before_and_after_open(spark):
    f = spark.createDataFrame([
        ("a", "A", "2020-01-03 03:00:00", "x", "work order"), ("b", "A", "2020-01-03 05:00:00", "x", "bags big order"),
        ("c", "A", "2020-01-03 05:00:00", None, "work order"), ("d", "A", "2020-01-03 05:00:00", "x", "dispatch")],
        "seq_id string, symbol string, announced_at string, category string, attachment_text string").withColumn("announced_at", F.col("announced_at").cast("timestamp"))
    ev = {r.seq_id: (str(r.tradeable_after), r.event_type) for r in ledger.typed_events(f).collect()}
    assert ev == {"a": ("2020-01-02", "firm-order"), "b": ("2020-01-03", "firm-order")}


def test_null_control_loses_the_cost(spark):
    # A stock that is the index: every excess is minus the cost, both directions.
    rnd = random.Random(1)
    xs = [100.0]
    for _ in range(300):
        xs.append(xs[-1] * (1 + rnd.gauss(0, 0.01)))
    b = bars(spark, xs, volume=10_000_000)
    idx = b.select(F.lit("I").alias("index_name"), "date", "open", "high", "low", "close")
    rows = waves.random_control(b, idx, share=3).where("exc_5 is not null").collect()
    assert len(rows) > 20 and all(abs(r.exc_5 + 0.35) < 1e-9 for r in rows)


def test_iv_round_trip(spark):
    rows = [("X", dt.date(2024, 1, 1), dt.date(2024, 3, 1), float(k), o, 1000.0, 500) for k in range(800, 1201, 50) for o in ("CE", "PE")]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, expiry date, strike double, option_type string, underlying double, volume long")
    tte = F.datediff("expiry", "trade_date") / 365.0
    df = M.with_black76(df, "close", F.col("underlying"), F.col("strike"), tte, F.lit(0.25), F.col("option_type") == "CE", M.discount(tte))
    got = options.option_iv(df).collect()
    assert len(got) > 10 and all(abs(r.iv - 0.25) < 2e-4 for r in got if 850 < r.strike < 1150)
    surf = options.daily_surface(options.option_iv(df)).first()
    assert surf.atm_iv == pytest.approx(0.25, abs=1e-4) and abs(surf.skew_25d) < 1e-3 and surf.next_expiry is None


def test_fill_statuses(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    chain = spark.createDataFrame([("X", dt.date(2024, 1, 30), 100.0, "CE", d, lo, hi) for d, lo, hi in zip(days, (1.0, 5.0, 9.0), (2.0, 6.0, 10.0))],
                                  "ticker string, expiry date, strike double, option_type string, trade_date date, low double, high double")
    f = [("long", 1.5, 9.5), ("short", 9.5, 1.5), ("same", 1.5, 1.6), ("miss", 1.5, 3.0), ("zero", 0.0, 5.5), ("expired", 5.5, 0.0)]
    fills = spark.createDataFrame([(n, "X", dt.date(2024, 1, 30), 100.0, "CE", b, s, 1.0) for n, b, s in f] + [("none", "X", None, 1.0, "CE", 1.0, 1.0, 1.0), ("nobars", "X", dt.date(2024, 2, 1), 1.0, "CE", 1.0, 1.0, 1.0)],
                                   "fill_id string, ticker string, expiry date, strike double, option_type string, buy double, sell double, pnl double")
    got = {r.fill_id: (r.status, r.side) for r in options.resolve_fills(fills, chain).collect()}
    assert got == {"long": ("resolved", "LONG"), "short": ("resolved", "SHORT"), "same": ("overlapping", None), "miss": ("price_not_found", None),
                   "zero": ("settled", "SHORT"), "expired": ("settled", "LONG"), "none": ("no_contract", None), "nobars": ("no_bars", None)}


def test_regime_basics(spark):
    b = bars(spark, [100 + (i % 7) for i in range(60)], 1).withColumn("underlier", F.lit("I"))
    vix = b.select("date", (F.lit(15.0) + F.dayofmonth("date") % 5).alias("vix"))
    rows = regime.regime_daily(b, vix).orderBy("date").collect()
    assert len(rows) == 59 and rows[0].vix_ma5 is None and rows[5].vix_ma5 is not None
    assert rows[-1].fwd_abs_1 is None and rows[0].regime_level_fixed == "normal"
