"""European calls under stochastic variance by one Fourier integral, for many rows at once.

With k = ln(S / K) + rT and the characteristic function f of the centred log price, the
call is S - sqrt(S K) exp(-rT/2) / pi times the integral over u > 0 of
Re(exp(iuk) f(u - i/2)) / (u^2 + 1/4).  The integrand is smooth at zero and falls off
with the expected variance.  It is summed over panels of doubling width, each parted
finely enough for its oscillation; a panel is halved while two Gauss rules on it disagree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Nodes of the two rules, halvings of a panel, panels, and panels in a row that must add nothing.
NODES, HALVINGS, PANELS, QUIET = (40, 56), 24, 64, 3
#: Points of the integrand that one price may take.
MAX_POINTS = 4_000_000
TOLERANCE = 1e-12
#: Prices that a task keeps.
KEPT = 10_000
INPUTS = ("spot", "strike", "rate", "maturity", "initial_variance", "reversion", "long_variance", "variance_volatility", "correlation")


@lru_cache(maxsize=4)
def _rule(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def integrated_variance(v0: float, kappa: float, theta: float, t: float) -> float:
    """Expected variance summed up to time t; small kappa * t goes by a series, which keeps the part of theta."""
    x = kappa * t
    if x < 1e-3:
        own = x / 2 - x * x / 6 + x**3 / 24 - x**4 / 120 + x**5 / 720
        return t * (v0 * (1 - own) + theta * own)
    weight = -math.expm1(-x) / x
    return t * (v0 * weight + theta * (1 - weight))


def _log1p(w: np.ndarray) -> np.ndarray:
    """Complex log(1 + w) that keeps small w."""
    small = np.abs(w) < 1e-3
    series = w * (1 - w * (1 / 2 - w * (1 / 3 - w * (1 / 4 - w * (1 / 5 - w / 6)))))
    return np.where(small, series, np.log(np.where(small, 1, 1 + w)))


def _characteristic(u: np.ndarray, t: float, v0: float, kappa: float, theta: float, xi: float, rho: float) -> np.ndarray:
    """f(u - i/2) of the log price less its drift, without division by a small xi."""
    w = u - 0.5j
    a = w * w + 1j * w  # = u^2 + 1/4
    beta = kappa - rho * xi * 1j * w
    d = np.sqrt(beta * beta + xi * xi * a)
    d = np.where(d.real < 0, -d, d)
    slope = -a / (beta + d)
    g = -xi * xi * a / (beta + d) ** 2
    decay = np.exp(-d * t)
    variance = slope * (1 - decay) / (1 - g * decay)
    # (2 / xi^2) * (log(1 - g decay) - log(1 - g)); g is of the order of xi^2
    ratio = g * (1 - decay) / (1 - g)
    spread = np.where(np.abs(ratio) < 1e-30, 2 * (-a / (beta + d) ** 2) * (1 - decay), 2 * _log1p(ratio) / (xi * xi))
    return np.exp(kappa * theta * (slope * t - spread) + variance * v0)


def heston_call(spot, strike, rate, maturity, initial_variance, reversion, long_variance, variance_volatility, correlation) -> float:
    """The price; ValueError for parameters outside the model, ArithmeticError where the integral does not settle."""
    given = (spot, strike, rate, maturity, initial_variance, reversion, long_variance, variance_volatility, correlation)
    if not all(map(math.isfinite, given)) or min(spot, strike, maturity) <= 0 or min(initial_variance, reversion, long_variance, variance_volatility) < 0 or abs(correlation) > 1:
        raise ValueError("parameters must be finite and within the model's bounds")
    discount = math.exp(-rate * maturity) if abs(rate * maturity) < 700 else 0.0
    owed = strike * discount
    total = integrated_variance(initial_variance, reversion, long_variance, maturity)
    if not (0 < owed < math.inf and math.isfinite(total)):
        raise ArithmeticError("the discounted strike or the variance is out of range")
    forward = math.log(spot / strike) + rate * maturity
    low = max(spot - owed, 0.0)
    if variance_volatility == 0 or initial_variance == 0 and reversion * long_variance == 0:
        if total == 0:
            return low
        root = math.sqrt(total)
        cdf = lambda x: math.erfc(-x / math.sqrt(2)) / 2
        return min(max(spot * cdf(forward / root + root / 2) - owed * cdf(forward / root - root / 2), low), spot)
    scale = math.sqrt(spot * owed) / math.pi
    enough = TOLERANCE * max(1.0, spot, owed) / scale

    def values(u: np.ndarray) -> np.ndarray:
        f = _characteristic(u, maturity, initial_variance, reversion, long_variance, variance_volatility, correlation)
        return (np.exp(1j * u * forward) * f).real / (u * u + 0.25)

    def panel(a: float, b: float, points: int) -> tuple[float, int]:
        """The integral from a to b, halved where the rules disagree."""
        parts = max(1, math.ceil((b - a) * abs(forward) / 12))
        edges = np.linspace(a, b, parts + 1)
        lo, hi, out = edges[:-1], edges[1:], 0.0
        for _ in range(HALVINGS):
            points += len(lo) * sum(NODES)
            if points > MAX_POINTS:
                raise ArithmeticError("the integral takes too many points")
            coarse, fine = ((values((hi + lo)[:, None] / 2 + (hi - lo)[:, None] / 2 * x) @ w) * (hi - lo) / 2 for x, w in map(_rule, NODES))
            if not np.isfinite(fine).all():
                raise ArithmeticError("the integrand is not finite")
            good = np.abs(fine - coarse) <= np.maximum(enough / 64, 4e-15 * np.abs(fine))
            out += float(fine[good].sum())
            if good.all():
                return out, points
            middle = (lo[~good] + hi[~good]) / 2
            lo, hi = np.concatenate([lo[~good], middle]), np.concatenate([middle, hi[~good]])
        raise ArithmeticError("the integral does not settle")

    whole, points, a, b, quiet = 0.0, 0, 0.0, 0.5, 0
    for _ in range(PANELS):
        part, points = panel(a, b, points)
        whole += part
        quiet = quiet + 1 if abs(part) <= enough / 8 and b * math.sqrt(total) > 6 else 0
        if quiet == QUIET:
            break
        a, b = b, 2 * b
    else:
        raise ArithmeticError("the integral's tail does not end")
    price = spot - scale * whole
    slack = 1e-10 * max(1.0, spot, owed)
    if not low - slack <= price <= spot + slack:
        raise ArithmeticError("the price is outside the bounds of a call")
    return min(max(price, low), spot)


def heston_calls(rows: DataFrame) -> DataFrame:
    """``rows``, which have the columns ``INPUTS``, with price and error (one of them null); columns of these names are replaced.

    A price takes milliseconds, so rows are first dealt out by their inputs: all cores
    work, and equal inputs meet in one task, which keeps its last ``KEPT`` prices.
    """
    rest = [c for c in rows.columns if c not in ("price", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=KEPT)
        def one(*given) -> tuple[float | None, str | None]:
            try:
                return (None, "a parameter is null") if None in given else (heston_call(*map(float, given)), None)
            except (ValueError, ArithmeticError) as x:
                return None, str(x)

        for b in batches:
            found = [one(*given) for given in zip(*(b.column(c).to_pylist() for c in INPUTS), strict=True)]
            prices, errors = [p for p, _ in found], [e for _, e in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(prices, pa.float64()), pa.array(errors, pa.string())], [*rest, "price", "error"])

    session = rows.sparkSession
    n = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(rest).repartition(n, *INPUTS).mapInArrow(run, rows.select(rest).schema.add("price", "double").add("error", "string"))
