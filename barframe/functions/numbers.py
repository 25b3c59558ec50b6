"""Rounding, parsing and small arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Round half toward +infinity, as a JavaScript ``Math.round`` does."""
    scale = float(10 ** digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def parse_number(c: Column | str) -> Column:
    """Leading decimal number of a text with thousands commas; NULL when there is none."""
    text = F.replace(as_col(c).cast("string"), F.lit(","), F.lit(""))
    lead = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return lead.try_cast("double")  # an empty one is none; asked once, so the pattern runs once


def pct_change(now: Column, before: Column) -> Column:
    return F.lit(100.0) * (now / before - F.lit(1.0))


def daily_change_pct(close: Column, prev: Column) -> Column:
    """Day change for display: two decimals, 0 when the previous close is missing or <= 0."""
    return F.when(prev.isNull() | (prev <= 0), F.lit(0.0)).otherwise(
        F.floor((close - prev) / prev * 10000.0 + 0.5) / 100.0
    )


# Typical free-float capitalisation by size category.
SIZE_BASE = {"large": 5e12, "mid": 4e11, "small": 6e10, "micro": 1.2e10}


def literal_lookup(key: Column, table: dict) -> Column:
    """Look a key up in a small literal table; NULL when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def size_estimate(category: Column, close: Column, volume: Column, avg_volume: Column) -> Column:
    """Tile size: liquidity proxy, geometrically blended with the category base where known."""
    vol = F.when(avg_volume > 0, avg_volume).otherwise(volume.cast("double"))
    liquidity = F.greatest(close, F.lit(1.0)) * F.greatest(vol, F.lit(1.0)) * 100.0
    base = literal_lookup(category, SIZE_BASE)
    blended = F.sqrt(base * F.greatest(liquidity, base * 0.1))
    return F.floor(F.coalesce(blended, liquidity) + 0.5)


def r_multiple(direction: Column, entry: Column, stop: Column, exit_: Column) -> Column:
    """Profit in units of initial risk, two decimals; 0 when the risk is 0."""
    risk = F.abs(entry - stop)
    pnl = F.when(direction == "long", exit_ - entry).otherwise(entry - exit_)
    return F.when(risk > 0, F.round(pnl / risk, 2)).otherwise(F.lit(0.0))


def position_size(capital: Column, risk_pct: Column, entry: Column, stop: Column) -> Column:
    """Whole units such that hitting the stop loses ``risk_pct`` of capital."""
    risk = F.abs(entry - stop)
    return F.when(risk > 0, F.floor(capital * (risk_pct / 100.0) / risk)).otherwise(F.lit(0))


def blend_scores(rule_score: Column, model_score: Column) -> Column:
    """Rule score and model score at 40/60, one decimal, clamped to 1..10."""
    return F.greatest(
        F.lit(1.0), F.least(F.lit(10.0), round_half_up(rule_score * 0.4 + model_score * 0.6, 1))
    )


def bucket(c: Column, cuts: list[tuple[float, str]], other: str | None = None, how: str = "ge") -> Column:
    """First matching label of an ordered cut list (``ge``, ``le``, ``lt``)."""
    test = {"ge": lambda x: c >= x, "le": lambda x: c <= x, "lt": lambda x: c < x}[how]
    out = None
    for edge, label in cuts:
        out = F.when(test(edge), label) if out is None else out.when(test(edge), label)
    return out if other is None else out.otherwise(other)


def right_closed_bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Bins (e0,e1], (e1,e2], ...; values outside all bins are NULL."""
    out = F.when(c <= edges[0], F.lit(None).cast("string"))
    for hi, label in zip(edges[1:], labels):
        out = out.when(c <= hi, label)
    return out


def period_label(date: Column, split: str, before: str = "TRAIN", after: str = "TEST") -> Column:
    return F.when(date < F.lit(split).cast("date"), before).otherwise(after)
