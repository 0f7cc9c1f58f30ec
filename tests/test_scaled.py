"""Scaled products and quotients against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from martingrid.functions import scaled
from martingrid.operators.simulate import RunSpec
from martingrid.operators.validation import feller_ratio

COLUMNS = "a double, b double, c double, d double"


def rounded(x):
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def test_split_and_ratio_equal_exact_fractions(spark):
    draw = random.Random(4)
    edge = [2.0**k * f for k in range(-1074, 1024, 7) for f in (1.0, 1.0 + 2.0**-52, 2.0 - 2.0**-52) if 2.0**k * f < math.inf]
    some = lambda: draw.choice((-1, 1)) * draw.choice((math.ldexp(draw.random() + 0.5, draw.randint(-1070, 1020)), draw.choice(edge), 5e-324, 1.7e308))
    rows = [(some(), some(), some(), some()) for _ in range(3_000)] + [(x, 1.0, 1.0, 1.0) for x in edge]
    table = spark.createDataFrame(rows, COLUMNS)
    got = table.select("*", scaled.split(F.col("a")).alias("s"), scaled.ratio([F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("r")).collect()
    for r in got:
        m, e = math.frexp(r.a)
        assert (r.s.m, r.s.e) == (2 * m, e - 1)
        exact = rounded(Fraction(r.a) * Fraction(r.b) / (Fraction(r.c) * Fraction(r.d)))
        assert r.r == exact or abs(r.r - exact) <= max(4 * math.ulp(exact), 5e-324), r
        assert math.isfinite(exact) or r.r == exact


def test_ratios_of_zeros_infinities_and_nulls(spark):
    inf, nan = math.inf, math.nan
    rows = [(0.0, 1.0, 1.0, 1.0), (0.0, 1.0, 0.0, 1.0), (-1.0, 1.0, 0.0, 1.0), (inf, 1.0, 2.0, 1.0), (1.0, 1.0, inf, 1.0), (nan, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (0.0, inf, 1.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, COLUMNS).coalesce(1).select(scaled.ratio([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])).collect()]
    assert [str(x) for x in got] == ["0.0", "nan", "-inf", "inf", "0.0", "nan", "None", "nan"]
    assert spark.createDataFrame([], COLUMNS).select(scaled.ratio([F.col("a")], [F.col("b")])).count() == 0


def test_feller_ratio_at_the_ends_of_the_range(spark):
    cases = {(1e308, 1e-308, 1e-10): 2e20, (1e-308, 1e-308, 1e-308): 2.0, (1e308, 1e308, 1e308): 2.0, (1e-300, 1e300, 1e150): 2e-300, (0.0, 1.0, 1.0): 0.0, (1.0, 1.0, 0.0): math.inf}
    table = spark.createDataFrame(list(cases), "a double, b double, c double")
    got = {(r.a, r.b, r.c): r.f for r in table.select("*", feller_ratio(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()}
    assert all(got[k] == pytest.approx(v, rel=1e-14) for k, v in cases.items())


def test_constants_that_are_not_finite_raise(spark):
    for bad in ({"volatility": 1e200}, {"rate": 1e9}, {"rate": -1e9}, {"rate": 1e308, "maturity": 1e308}, {"maturity": 1e308, "volatility": 1e10}):
        with pytest.raises(ValueError, match="constant"):
            RunSpec(**bad)
    with pytest.raises(ValueError, match="constant"):
        RunSpec(model="heston", reversion=1e308, long_variance=1e10)
    with pytest.raises(Exception, match="a price is not finite"):
        spark.range(1).select(scaled.finite_or_raise(F.lit(math.inf), "a price")).collect()
