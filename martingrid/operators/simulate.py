"""Scenario blocks, one-step and multi-step path simulation, block statistics and their reduction."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martingrid.functions import rng
from martingrid.functions.heston import heston_call
from martingrid.functions.pricing import black_scholes_call, confidence, standard_error

#: Leaves that one task reduces; a power of two, so grouping does not change the tree.
FAN_IN = 1024


@dataclass(frozen=True)
class RunSpec:
    seed: int = 1
    scenarios: int = 100_000
    steps: int = 1
    maturity: float = 1.0
    spot: float = 100.0
    strike: float = 100.0
    rate: float = 0.05
    volatility: float = 0.2
    payoff: str = "european_call"
    block_size: int = 2048
    model: str = "gbm"
    antithetic: bool = False
    initial_variance: float = 0.04
    reversion: float = 1.5
    long_variance: float = 0.04
    variance_volatility: float = 0.3
    correlation: float = -0.7

    def __post_init__(self):
        if not (1 <= self.scenarios <= rng.MAX_SCENARIOS and 1 <= self.steps <= rng.MAX_STEPS and self.block_size >= 1):
            raise ValueError("scenarios, steps or block size out of range")
        if self.payoff not in ("european_call", "asian_call"):
            raise ValueError(f"unknown payoff {self.payoff}")
        if not all(map(math.isfinite, (self.maturity, self.spot, self.strike, self.rate, self.volatility))) or min(self.maturity, self.spot, self.strike, self.volatility) <= 0:
            raise ValueError("parameters must be finite, and all but the rate above zero")
        if self.antithetic and (self.scenarios % 2 or self.block_size % 2):
            raise ValueError("antithetic runs need even scenario counts and block sizes")
        if self.model not in ("gbm", "heston"):
            raise ValueError(f"unknown model {self.model}")
        if self.model == "heston":
            variance = (self.initial_variance, self.reversion, self.long_variance, self.variance_volatility)
            if not all(math.isfinite(x) and x >= 0 for x in variance) or not -1 <= self.correlation <= 1:
                raise ValueError("variance parameters must be finite and not negative, the correlation within -1 and 1")
        self._check_constants()

    def _check_constants(self) -> None:
        """What the kernels multiply by must be finite, and the discount above zero."""
        dt = self.maturity / self.steps
        try:
            found = [dt, self.rate * dt, self.discount]
            if self.model == "gbm":
                found += [self.drift, self.diffusion]
            else:
                found += [self.reversion * dt * self.long_variance, self.variance_volatility * math.sqrt(dt), math.sqrt(self.initial_variance * dt)]
        except OverflowError:
            found = [math.inf]
        if not all(map(math.isfinite, found)) or dt <= 0 or self.discount <= 0:
            raise ValueError("a derived constant is not finite, or the discount is zero")

    @property
    def drift(self) -> float:
        return (self.rate - 0.5 * self.volatility**2) * self.maturity / self.steps

    @property
    def diffusion(self) -> float:
        return self.volatility * math.sqrt(self.maturity / self.steps)

    @property
    def discount(self) -> float:
        return math.exp(-self.rate * self.maturity)


def blocks(spark: SparkSession, spec: RunSpec, low: int = 0, high: int | None = None) -> DataFrame:
    """(block_id, start_scenario, end_scenario): contiguous ranges that cover all scenarios, or those of the ids from ``low`` and below ``high``."""
    n = -(-spec.scenarios // spec.block_size)
    return spark.range(low, n if high is None else min(n, high)).select(
        F.col("id").alias("block_id"),
        (F.col("id") * spec.block_size).alias("start_scenario"),
        F.least((F.col("id") + 1) * spec.block_size, F.lit(spec.scenarios)).alias("end_scenario"),
    )


def normals(rows: DataFrame, seed: int, scenario: str = "scenario", step: str = "step", dimension: int = 0) -> DataFrame:
    """``rows`` with the columns u and z of their coordinates."""
    words = rng.with_words(rows, seed, F.col(scenario), F.col(step), F.lit(dimension), F.lit(0))
    drawn = words.withColumn("u", rng.uniform(F.col("w0"), F.col("w1"))).drop("w0", "w1", "w2", "w3")
    return drawn.withColumn("z", rng.inverse_normal(F.col("u")))


def one_step_payoffs(spark: SparkSession, spec: RunSpec) -> DataFrame:
    """(scenario, block_id, payoff) of a one-step European call, in Spark expressions only."""
    if spec.steps != 1:
        raise ValueError("this form has one step; use block_stats for more")
    rows = spark.range(spec.scenarios).select(F.col("id").alias("scenario"), F.lit(0).cast("long").alias("step"))
    final = F.lit(spec.spot) * F.exp(F.lit(spec.drift) + F.lit(spec.diffusion) * F.col("z"))
    paid = F.lit(spec.discount) * F.greatest(final - F.lit(spec.strike), F.lit(0.0))
    return normals(rows, spec.seed).select("scenario", F.expr(f"scenario div {spec.block_size}").alias("block_id"), paid.alias("payoff"))


def _draws(seed: int, scenario: np.ndarray, step: int, dimension: int = 0) -> np.ndarray:
    m, s32 = np.uint64(rng.MASK), np.uint64(32)
    c = [scenario & m, (scenario >> s32) | np.uint64(step << 8), np.full_like(scenario, dimension), np.zeros_like(scenario)]
    k = [seed & rng.MASK, seed >> 32 & rng.MASK]
    for _ in range(rng.ROUNDS):
        p, q = c[0], c[2]
        p *= np.uint64(rng.MULTIPLIERS[0])
        q *= np.uint64(rng.MULTIPLIERS[1])
        one, three = c[1], c[3]
        one ^= q >> s32
        one ^= np.uint64(k[0])
        three ^= p >> s32
        three ^= np.uint64(k[1])
        q &= m
        p &= m
        c = [one, q, three, p]
        k = [(x + w) & rng.MASK for x, w in zip(k, rng.WEYL, strict=True)]
    raw = c[0] << np.uint64(21) | c[1] >> np.uint64(11)
    u = np.maximum(raw.astype(float) * 2.0**-53, 2.0**-54)
    q = u - 0.5
    z = np.polyval(rng.ACKLAM_A, q * q) * q / np.polyval(rng.ACKLAM_B, q * q)
    ends = np.flatnonzero(np.abs(q) > 0.5 - rng.ACKLAM_LOW)
    if len(ends):
        v = u[ends]
        low = v < 0.5
        tail = np.sqrt(-2 * np.log(np.where(low, v, 1 - v)))
        far = np.polyval(rng.ACKLAM_C, tail) / np.polyval(rng.ACKLAM_D, tail)
        out = (v < rng.ACKLAM_LOW) | (v > 1 - rng.ACKLAM_LOW)
        z[ends[out]] = np.where(low, far, -far)[out]
    return z


def _walk(spec: RunSpec, scenario: np.ndarray, sign: float) -> np.ndarray:
    price, total = np.full(len(scenario), spec.spot), np.zeros(len(scenario))
    dt = spec.maturity / spec.steps
    root, other = math.sqrt(dt), math.sqrt(max(0.0, 1 - spec.correlation**2))
    variance = np.full(len(scenario), spec.initial_variance)
    for step in range(spec.steps):
        z = _draws(spec.seed, scenario, step)
        if sign < 0:
            np.negative(z, out=z)
        if spec.model == "gbm":
            price = price * np.exp(spec.drift + spec.diffusion * z)
        else:  # full truncation: the variance may go below zero, its square root and drift use the positive part
            above = np.maximum(variance, 0.0)
            spread = np.sqrt(above) * root
            price = price * np.exp((spec.rate - 0.5 * above) * dt + spread * z)
            shock = spec.correlation * z + other * sign * _draws(spec.seed, scenario, step, 1)
            variance = variance + spec.reversion * (spec.long_variance - above) * dt + spec.variance_volatility * spread * shock
        if not (np.isfinite(price) & (price > 0)).all():
            bad = int(np.flatnonzero(~(np.isfinite(price) & (price > 0)))[0])
            raise ArithmeticError(f"the price of scenario {scenario[bad]} left the positive numbers at step {step}")
        total += price
    settled = price if spec.payoff == "european_call" else total / spec.steps
    return spec.discount * np.maximum(settled - spec.strike, 0.0)


def discounted_payoff(spec: RunSpec, scenario: int) -> float:
    """The payoff of one scenario, or of the pair of an even one in antithetic runs."""
    if not 0 <= scenario < spec.scenarios or spec.antithetic and scenario % 2:
        raise ValueError("no such scenario")
    return float(_payoffs(spec, scenario, scenario + (2 if spec.antithetic else 1))[1][0])


def _payoffs(spec: RunSpec, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Scenarios and payoffs of a block; antithetic runs give the mean of each pair under its even number."""
    if spec.antithetic:
        even = np.arange(start, end, 2, dtype=np.uint64)
        return even, 0.5 * (_walk(spec, even, 1.0) + _walk(spec, even, -1.0))
    scenario = np.arange(start, end, dtype=np.uint64)
    return scenario, _walk(spec, scenario, 1.0)


def path_payoffs(spark: SparkSession, spec: RunSpec) -> DataFrame:
    """(scenario, payoff) of every path or antithetic pair, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in zip(b.column("start_scenario").to_pylist(), b.column("end_scenario").to_pylist(), strict=True):
                scenario, x = _payoffs(spec, start, end)
                yield pa.RecordBatch.from_arrays([pa.array(scenario.astype(np.int64)), pa.array(x)], ["scenario", "payoff"])

    return blocks(spark, spec).mapInArrow(run, "scenario long, payoff double")


STATS = "block_id long, n long, mean double, m2 double, min double, max double"


#: Scenarios whose paths a worker walks at a time, and blocks whose statistics it forms at a time.
WALKED, ABREAST = 1 << 17, 256


def ordered_stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of each row: Welford's pass in order of the columns, all rows abreast."""
    columns = np.ascontiguousarray(x.T)
    mean, m2 = np.zeros(len(x)), np.zeros(len(x))
    for i, v in enumerate(columns, 1):
        delta = v - mean
        mean += delta / i
        m2 += delta * (v - mean)
    return mean, m2


def block_stats(spark: SparkSession, spec: RunSpec, todo: DataFrame | None = None) -> DataFrame:
    """One row of statistics per block (of ``todo``, or all): an ordered pass over its scenarios, without a shuffle."""

    def some(ids: list[int], starts: list[int], size: int) -> pa.RecordBatch:
        x = np.concatenate([_payoffs(spec, starts[i], starts[i] + size * min(per, len(ids) - i))[1] if near else np.concatenate([_payoffs(spec, s, s + size)[1] for s in starts[i : i + per]]) for i, near, per in _together(starts, size)])
        if not np.isfinite(x).all():
            raise ArithmeticError(f"a payoff within blocks {min(ids)} to {max(ids)} is not finite")
        x = x.reshape(len(ids), -1)
        mean, m2 = ordered_stats(x)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.shape[1]] * len(ids), pa.int64()), *map(pa.array, (mean, m2, x.min(1), x.max(1)))], _STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, start, end = (b.column(c).to_pylist() for c in ("block_id", "start_scenario", "end_scenario"))
            size = [y - x for x, y in zip(start, end, strict=True)]
            for n in sorted(set(size)):
                own = [i for i, m in enumerate(size) if m == n]
                step = max(1, min(ABREAST, (1 << 22) // n))
                for a in range(0, len(own), step):
                    yield some([ids[i] for i in own[a : a + step]], [start[i] for i in own[a : a + step]], n)

    todo = blocks(spark, spec) if todo is None else todo
    return todo.select("block_id", "start_scenario", "end_scenario").mapInArrow(run, STATS)


def _together(starts: list[int], size: int) -> Iterator[tuple[int, bool, int]]:
    """(first, whether neighbours, how many) of the blocks walked at a time."""
    per = max(1, WALKED // size)
    for i in range(0, len(starts), per):
        own = starts[i : i + per]
        yield i, all(y - x == size for x, y in zip(own, own[1:])), per


_STATS = ["block_id", "n", "mean", "m2", "min", "max"]


def merge_stats(a: tuple, b: tuple) -> tuple:
    """Statistics (n, mean, m2, min, max) of both parts together."""
    if not a[0] or not b[0]:
        return b if b[0] else a
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * b[0] / n, a[2] + b[2] + delta * delta * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])


def _tree(n_blocks: int, partial: bool):
    """A task of the tree: the statistics under one parent, each at the position of its id."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        parent = int(part["block_id"].iloc[0]) // FAN_IN
        size = min(FAN_IN, n_blocks - parent * FAN_IN)
        level = [(0, 0.0, 0.0, 0.0, 0.0)] * size
        for b, *leaf in part[_STATS].itertuples(index=False, name=None):
            at = int(b) - parent * FAN_IN
            if not 0 <= at < size or level[at][0]:
                raise ValueError(f"block {b} is repeated or outside the run")
            level[at] = tuple(leaf)
        if not partial and not all(x[0] for x in level):
            raise ValueError(f"{sum(not x[0] for x in level)} blocks are missing under position {parent}")
        while len(level) > 1:
            level = [merge_stats(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pd.DataFrame([(parent, *level[0])], columns=_STATS)

    return run


def reduce_blocks(stats: DataFrame, n_blocks: int, partial: bool = False) -> DataFrame:
    """One row: the fixed-position pairwise tree over block ids, FAN_IN leaves to a task, level by level.

    A repeated block, or one outside the run, raises; so does a missing one, or with
    ``partial`` counts as empty at its position.  Of no rows at all there is no result.
    """
    while True:
        stats = stats.groupBy(F.expr(f"block_id div {FAN_IN}").alias("parent")).applyInPandas(_tree(n_blocks, partial), STATS)
        n_blocks = -(-n_blocks // FAN_IN)
        if n_blocks <= 1:
            return stats


def _heston_or_none(spec: RunSpec) -> float | None:
    """The reference price of a European call of stochastic volatility; none where its integral can't be formed."""
    if spec.payoff != "european_call" or spec.model != "heston":
        return None
    try:
        return heston_call(spec.spot, spec.strike, spec.rate, spec.maturity, spec.initial_variance, spec.reversion, spec.long_variance, spec.variance_volatility, spec.correlation)
    except ArithmeticError:
        return None


def price(spark: SparkSession, spec: RunSpec) -> DataFrame:
    """One row: price, standard error, interval, and for European calls the reference price and the error against it."""
    whole = reduce_blocks(block_stats(spark, spec), -(-spec.scenarios // spec.block_size))
    n, mean, m2 = F.col("n"), F.col("mean"), F.col("m2")
    low, high = confidence(n, mean, m2)
    exact = black_scholes_call(*[F.lit(x) for x in (spec.spot, spec.strike, spec.rate, spec.volatility, spec.maturity)])
    oracle = exact if spec.payoff == "european_call" and spec.model == "gbm" else F.lit(_heston_or_none(spec)).cast("double")
    return whole.select(n, mean.alias("price"), standard_error(n, m2).alias("standard_error"), low.alias("ci_low"), high.alias("ci_high"), "min", "max", oracle.alias("analytic")).withColumn(
        "analytic_error", F.col("price") - F.col("analytic")
    )
