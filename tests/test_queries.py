"""A cross-section of the registered queries against their SQL twins on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "bars_from_trades", "indicator_history", "screener_replay", "adjusted_prices", "event_outcomes", "base_rates", "gap_panel", "fade_up_gaps",
    "wave_signals", "fade_outcomes", "backtest_summary", "stop_report", "implied_forwards", "option_buyer_by_dte", "resolve_fills", "regime_daily",
    "extract_entities", "impact_score", "content_hash", "scan_equity_eod", "scan_filing_archive", "upsert_rows",
]


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(data_dir, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, data_dir, name):
    df = driver.queries()[name](spark, data_dir)
    rel = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want


def test_registry_is_consistent():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(driver.queries()) > 120
