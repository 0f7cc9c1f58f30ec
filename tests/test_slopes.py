import statistics

import numpy as np
import pytest

from martingrid.operators import gate, slopes


def all_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    d = x[j] != x[i]
    s = (y[j] - y[i])[d] / (x[j] - x[i])[d]
    return len(s), statistics.median(s.tolist()) if len(s) else None


def test_inversions_and_residuals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 301):
        p = rng.permutation(n)
        assert slopes.inversions(p) == sum(int((p[:i] > p[i]).sum()) for i in range(n))
    from fractions import Fraction

    x, y = rng.standard_normal(50) * 1e6, rng.standard_normal(50)
    for t in (0.1, -3e5, 1 / 3):
        for a, b, *z in zip(x, y, *slopes.residual(x, y, t), strict=True):
            assert sum(map(Fraction, z)) == Fraction(b) - Fraction(t) * Fraction(a)


@pytest.mark.parametrize("kind", ["smooth", "ties", "flat"])
def test_selected_slope_equals_that_of_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    n = 900
    x = rng.permutation(n).astype(float)
    y = {"smooth": 0.3 * x + rng.standard_normal(n) * 40, "ties": np.floor(x / 7) + rng.integers(0, 3, n), "flat": np.full(n, 2.5)}[kind]
    if kind == "ties":
        x = np.floor(x / 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (3.0, None), (5.0, float("nan"))], "x double, y double")
    pairs, slope = all_pairs(x, y)
    assert slopes.median_slope(df, "x", "y") == (pairs, slope)
    assert slopes.median_slope(df, "x", "y", listed=2_000) == (pairs, pytest.approx(slope, abs=1e-15))


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "i long, r double")
    assert tuple(gate.theil_sen(df, "i", "r").first()) == (0, None, None)
    assert tuple(gate.theil_sen(df.limit(0), "i", "r").first()) == (0, None, None)
