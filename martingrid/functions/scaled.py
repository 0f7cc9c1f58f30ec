"""Products and quotients of doubles whose steps would overflow or underflow, as Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from martingrid.functions.ieee import BIAS, FRACTION

#: Exponents of the least normal and of the least positive number.
LEAST_NORMAL, LEAST = 1 - BIAS, 1 - BIAS - FRACTION


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def split(x: Column) -> Column:
    """(m, e) with x = m * 2^e and 1 <= |m| < 2, exactly; m is x itself and e zero for 0, NaN and infinities; null stays null."""

    def size(a: Column) -> Column:
        tiny = a < 2.0**LEAST_NORMAL
        lifted = F.when(tiny, a * 2.0**537 * 2.0**537).otherwise(a)
        offset = F.when(tiny, 2 * -537).otherwise(0)

        def normal(y: Column) -> Column:
            guess = F.least(F.greatest(F.floor(F.log2(y)), F.lit(LEAST_NORMAL)), F.lit(BIAS)).cast("int")
            fraction = lambda e: F.struct((y / F.pow(F.lit(2.0), e.cast("double"))).alias("m"), e.alias("e"))
            # the logarithm may be off by one next to powers of two
            near = lambda p: F.when(p["m"] >= 2, F.struct((p["m"] / 2).alias("m"), (p["e"] + 1).alias("e"))).when(p["m"] < 1, F.struct((p["m"] * 2).alias("m"), (p["e"] - 1).alias("e"))).otherwise(p)
            return _let(_let(guess, fraction), near)

        return _let(_let(lifted, normal), lambda p: F.struct((F.signum(x) * p["m"]).alias("m"), (p["e"] + offset).alias("e")))

    plain = (x == 0) | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull(), None).when(plain, F.struct(x.alias("m"), F.lit(0).alias("e"))).otherwise(size(F.abs(x)))


def join(m: Column, e: Column) -> Column:
    """m * 2^e for 1 <= |m| < 2, rounded once; too large gives an infinity, too small a zero."""
    power = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    small = m * 2.0**LEAST_NORMAL * power(F.greatest(e, F.lit(LEAST - 2)) - LEAST_NORMAL)
    return F.when(e < LEAST_NORMAL, small).when(e > BIAS, m * float("inf")).otherwise(m * power(e))


def ratio(above: list[Column], below: list[Column]) -> Column:
    """The product of ``above`` over that of ``below`` (at most 500 factors each), with the exponents added apart.

    Only the result can overflow or underflow, never a step.  A null factor gives null; zeros,
    infinities and NaN count as in plain arithmetic, so that 0 over 0 is NaN and 1 over 0 infinite.
    """
    if len(above) > 500 or len(below) > 500:
        raise ValueError("at most 500 factors")
    names = [f"a{i}" for i in range(len(above))], [f"b{i}" for i in range(len(below))]
    parts = F.struct(*[split(x.cast("double")).alias(n) for xs, ns in zip((above, below), names, strict=True) for x, n in zip(xs, ns, strict=True)])

    def made(p: Column) -> Column:
        product = lambda ns: reduce(mul, [p[n]["m"] for n in ns], F.lit(1.0))
        total = lambda ns: reduce(lambda a, b: a + b, [p[n]["e"] for n in ns], F.lit(0))
        over, under = product(names[0]), product(names[1])
        zero = F.when((over == 0) | F.isnan(over) | F.isnan(under), float("nan")).otherwise(F.signum(over) * float("inf"))
        fraction = F.when(under == 0, zero).otherwise(F.try_divide(over, under))
        return _let(split(fraction), lambda f: F.when((f["m"] == 0) | F.isnan(f["m"]) | (F.abs(f["m"]) == float("inf")), f["m"]).otherwise(join(f["m"], f["e"] + total(names[0]) - total(names[1]))))

    return _let(parts, made)


def finite_or_raise(x: Column, what: str) -> Column:
    """``x``; a row where it is null, NaN or infinite stops the query with ``what``."""
    return F.when(F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)), x).otherwise(F.raise_error(F.lit(f"{what} is not finite")))
