"""Closed forms and statistics as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hart's rational form of the normal distribution function.
HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT, ROOT_TWO_PI = 7.07106781186547, 2.506628274631
#: Normal intervals need so many observations.
CI_MINIMUM, CI_Z = 30, 1.96


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    far = a
    for k in (0.65, 4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(k) if k == 0.65 else a + F.lit(k) / far
    below = F.when(a > 37, 0.0).when(a < HART_SPLIT, e * _horner(HART_P, a) / _horner(HART_Q, a)).otherwise(e / far / ROOT_TWO_PI)
    return F.when(x > 0, 1 - below).otherwise(below)


def finite(x: Column) -> Column:
    """Whether a value is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def black_scholes_call(spot: Column, strike: Column, rate: Column, volatility: Column, maturity: Column) -> Column:
    """Price of a European call; null unless all inputs and the price are finite, and all but the rate above zero."""
    spread = volatility * F.sqrt(maturity)
    d1 = (F.ln(spot / strike) + (rate + volatility * volatility / 2) * maturity) / spread
    price = spot * normal_cdf(d1) - strike * F.exp(-rate * maturity) * normal_cdf(d1 - spread)
    good = finite(rate)
    for x in (spot, strike, volatility, maturity):
        good = good & finite(x) & (x > 0)
    return F.when(good, F.when(finite(price), price))


def sample_variance(n: Column, m2: Column) -> Column:
    return F.when(n >= 2, m2 / (n - 1))


def standard_error(n: Column, m2: Column) -> Column:
    return F.sqrt(sample_variance(n, m2) / n)


def confidence(n: Column, mean: Column, m2: Column, z: float = CI_Z) -> tuple[Column, Column]:
    """Bounds of the normal interval; both null below 30 observations, and where either is not finite."""
    if not (math.isfinite(z) and z > 0):
        raise ValueError("z must be finite and above zero")
    half = standard_error(n, m2) * z
    low, high = mean - half, mean + half
    good = (n >= CI_MINIMUM) & finite(low) & finite(high)
    return F.when(good, low), F.when(good, high)
