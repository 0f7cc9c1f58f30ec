"""Counter-based random numbers as Spark columns: a draw depends on its coordinates alone.

Products of 32-bit words are formed from 16-bit halves, so no signed long overflows;
each round is one projection, which stays within whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the Philox4x32-10 generator.
MULTIPLIERS, WEYL, ROUNDS = (0xD2511F53, 0xCD9E8D57), (0x9E3779B9, 0xBB67AE85), 10
MASK = 0xFFFFFFFF
#: Limits of the coordinates.
MAX_SCENARIOS, MAX_STEPS, MAX_DIMENSIONS, MAX_DRAWS = 1 << 40, 1 << 24, 1 << 8, 1 << 24
#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ACKLAM_LOW = 0.02425


def _product(m: int, c: Column) -> tuple[Column, Column]:
    """High and low 32 bits of m * c."""
    low = F.lit(m) * c.bitwiseAND(0xFFFF)
    upper = F.lit(m) * F.shiftright(c, 16) + F.shiftright(low, 16)
    return F.shiftright(upper, 16), F.shiftleft(upper.bitwiseAND(0xFFFF), 16).bitwiseOR(low.bitwiseAND(0xFFFF))


def with_words(rows: DataFrame, seed: int, scenario: Column, step: Column, dimension: Column, draw: Column) -> DataFrame:
    """``rows`` with the output words w0 to w3 (longs below 2^32) of the coordinates."""
    checked = F.when(
        scenario.between(0, MAX_SCENARIOS - 1) & step.between(0, MAX_STEPS - 1) & dimension.between(0, MAX_DIMENSIONS - 1) & draw.between(0, MAX_DRAWS - 1), scenario.cast("long")
    ).otherwise(F.raise_error(F.lit("random coordinate out of range")).cast("long"))
    keep = [F.col(c) for c in rows.columns]
    state = rows.select(
        *keep,
        checked.bitwiseAND(MASK).alias("w0"),
        F.shiftright(checked, 32).bitwiseOR(F.shiftleft(step.cast("long"), 8)).alias("w1"),
        dimension.cast("long").bitwiseOR(F.shiftleft(draw.cast("long"), 8)).alias("w2"),
        F.lit(0).cast("long").alias("w3"),
    )
    key = [seed & MASK, seed >> 32 & MASK]
    for _ in range(ROUNDS):
        (h0, l0), (h1, l1) = _product(MULTIPLIERS[0], F.col("w0")), _product(MULTIPLIERS[1], F.col("w2"))
        state = state.select(
            *keep,
            h1.bitwiseXOR(F.col("w1")).bitwiseXOR(F.lit(key[0])).alias("w0"),
            l1.alias("w1"),
            h0.bitwiseXOR(F.col("w3")).bitwiseXOR(F.lit(key[1])).alias("w2"),
            l0.alias("w3"),
        )
        key = [(k + w) & MASK for k, w in zip(key, WEYL, strict=True)]
    return state


def uniform(w0: Column, w1: Column) -> Column:
    """The open unit interval: 53 bits of the first two words, zero becoming 2^-54."""
    raw = F.shiftleft(w0, 21).bitwiseOR(F.shiftright(w1, 11))
    return F.when(raw == 0, F.lit(2.0**-54)).otherwise(raw.cast("double") * F.lit(2.0**-53))


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside the open unit interval."""
    q, tail = p - 0.5, lambda x: F.sqrt(F.lit(-2.0) * F.ln(x))
    ends = lambda x: _horner(ACKLAM_C, tail(x)) / _horner(ACKLAM_D, tail(x))
    middle = _horner(ACKLAM_A, q * q) * q / _horner(ACKLAM_B, q * q)
    return F.when((p > 0) & (p < ACKLAM_LOW), ends(p)).when((p >= ACKLAM_LOW) & (p <= 1 - ACKLAM_LOW), middle).when((p > 1 - ACKLAM_LOW) & (p < 1), -ends(1 - p))


def raw_hex(w0: Column, w1: Column) -> Column:
    """The 64-bit value of the first two words, as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.shiftleft(w0, 32).bitwiseOR(w1)), 16, "0"))


def raw_stream(spark: SparkSession, seed: int, words: int, dimensions: int = 1) -> DataFrame:
    """(position, scenario, dimension, raw): the stream scenario by scenario, dimensions within.

    Write it with ``stream_lines`` where a program wants it in order.
    """
    if not (0 < words and 1 <= dimensions <= MAX_DIMENSIONS and (words - 1) // dimensions < MAX_SCENARIOS):
        raise ValueError("words or dimensions out of range")
    rows = spark.range(words).select(F.col("id").alias("position"), F.expr(f"id div {dimensions}").alias("scenario"), (F.col("id") % dimensions).cast("int").alias("dimension"))
    drawn = with_words(rows, seed, F.col("scenario"), F.lit(0), F.col("dimension"), F.lit(0))
    return drawn.select("position", "scenario", "dimension", raw_hex(F.col("w0"), F.col("w1")).alias("raw"))


def stream_lines(stream: DataFrame, path: str) -> None:
    """The stream as text, a hex word a line; the files' names are in the order of positions."""
    stream.orderBy("position").select("raw").write.mode("errorifexists").text(path)
