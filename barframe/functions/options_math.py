"""Black-76 on forwards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICK = 0.05
RATE = 0.065
IV_LOW, IV_HIGH = 0.005, 5.0
BISECTION_STEPS = 60


def erf(x: Column) -> Column:
    """Error function by the Abramowitz-Stegun 7.1.26 polynomial (|error| < 1.5e-7)."""
    # Published coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    mag = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * mag)
    poly = F.lit(a[4])
    for coefficient in (a[3], a[2], a[1], a[0]):
        poly = poly * t + F.lit(coefficient)
    return F.signum(x) * (F.lit(1.0) - poly * t * F.exp(-mag * mag))


def normal_cdf(x: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(x / F.sqrt(F.lit(2.0))))


def discount(tte: Column, rate: float = RATE) -> Column:
    return F.exp(F.lit(-rate) * tte)


def _d1(forward: Column, strike: Column, tte: Column, vol: Column) -> tuple[Column, Column]:
    spread = F.greatest(vol * F.sqrt(tte), F.lit(1e-12))
    return (F.log(forward / strike) + F.lit(0.5) * vol * vol * tte) / spread, spread


def black76(forward, strike, tte, vol, is_call, df) -> Column:
    d1, spread = _d1(forward, strike, tte, vol)
    return _price(d1, d1 - spread, forward, strike, is_call, df)


def _price(d1, d2, forward, strike, is_call, df) -> Column:
    # One side per row: the sign turns the call formula into the put's.
    side = F.when(is_call, 1.0).otherwise(-1.0)
    return side * df * (forward * normal_cdf(side * d1) - strike * normal_cdf(side * d2))


def with_black76(frame: DataFrame, out: str, forward, strike, tte, vol, is_call, df) -> DataFrame:
    """The price as a column, computed over named intermediates.

    Each intermediate is evaluated once per row and the generated code stays small, which a
    single nested expression cannot promise.
    """
    d1, spread = _d1(forward, strike, tte, vol)
    side = F.when(is_call, 1.0).otherwise(-1.0)
    frame = frame.withColumns({"_side": side, "_d1": d1, "_sp": spread})
    frame = frame.withColumns({"_u1": F.col("_side") * F.col("_d1"), "_u2": F.col("_side") * (F.col("_d1") - F.col("_sp"))})
    frame = frame.withColumns({"_n1": normal_cdf(F.col("_u1")), "_n2": normal_cdf(F.col("_u2"))})
    price = F.col("_side") * df * (forward * F.col("_n1") - strike * F.col("_n2"))
    return frame.withColumn(out, price).drop("_side", "_d1", "_sp", "_u1", "_u2", "_n1", "_n2")


def with_delta(frame: DataFrame, out: str, forward, strike, tte, vol, is_call, df) -> DataFrame:
    d1, _ = _d1(forward, strike, tte, vol)
    frame = frame.withColumn("_side", F.when(is_call, 1.0).otherwise(-1.0)).withColumn("_u1", d1)
    frame = frame.withColumn("_n1", normal_cdf(F.col("_side") * F.col("_u1")))
    return frame.withColumn(out, F.col("_side") * df * F.col("_n1")).drop("_side", "_u1", "_n1")


def delta(forward, strike, tte, vol, is_call, df) -> Column:
    d1, _ = _d1(forward, strike, tte, vol)
    return F.when(is_call, df * normal_cdf(d1)).otherwise(-df * normal_cdf(-d1))


def moneyness(strike: Column, forward: Column) -> Column:
    return strike / forward - F.lit(1.0)


def intrinsic(reference: Column, strike: Column, is_call: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(is_call, reference - strike).otherwise(strike - reference))


def half_spread(price: Column, tick: float = TICK, share: float = 0.005) -> Column:
    """Half the quoted spread as a share of price: at least one tick."""
    return F.greatest(F.lit(tick), F.lit(share) * price) / price


def net_option_return(entry: Column, exit_: Column, tick: float = TICK) -> Column:
    """Percent return after paying the half-spread on both sides."""
    paid_out = half_spread(F.greatest(exit_, F.lit(tick)), tick)
    return F.lit(100.0) * (
        exit_ * (F.lit(1.0) - paid_out) / (entry * (F.lit(1.0) + half_spread(entry, tick))) - F.lit(1.0)
    )


def out_of_the_money_pct(strike: Column, spot: Column, is_call: Column) -> Column:
    raw = F.lit(100.0) * (strike / spot - F.lit(1.0))
    return F.when(is_call, raw).otherwise(-raw)
