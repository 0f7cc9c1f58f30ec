"""Robust statistics of benchmark gates, per group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.operators import ranks, slopes


def nearest_rank(rows: DataFrame, group: str, value: str, at=(0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles p50, p95, ...; zeros mean that there is no sample."""
    found = ranks.values_at(rows.where(F.col(value) != 0), [group], value, [ranks.nearest(p) for p in at])
    return found.select(group, F.col("total").alias("n"), *[F.col(f"v{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(at)])


def linear_quantiles(rows: DataFrame, group: str, value: str, at=(0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles interpolated between neighbours (type 7), and the interquartile range."""
    found = ranks.quantiles(rows, [group], value, at)
    q = found.select(group, *[F.col(f"q{i}").alias(f"q{round(p * 100)}") for i, p in enumerate(at)])
    return q.withColumn("iqr", F.col("q75") - F.col("q25")) if {0.25, 0.75} <= set(at) else q


def median_deviation(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, mad): the median and the unscaled median absolute deviation."""
    middle = ranks.quantiles(rows, [group], value, [0.5]).select(F.col(group).alias("_group"), F.col("q0").alias("_median"))
    counted = rows.groupBy(group, value).agg(F.count(value).alias("_times"))
    away = counted.join(middle, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_away", F.abs(F.col(value) - F.col("_median")))
    mad = ranks.quantiles(away, [group, "_median"], "_away", [0.5], times="_times")
    return mad.select(group, F.col("_median").alias("median"), F.col("q0").alias("mad"))


def theil_sen(rates: DataFrame, index: str, rate: str) -> DataFrame:
    """One row (pairs, slope, drift_pct): the median slope over all pairs of runs, and its share of the median rate over the span.

    No pairs are formed but those near the median, so runs may be as many as a table
    has rows.  Runs with a null or a value that is not finite are left out; runs of one
    index make no pair; without pairs slope and drift are null.
    """
    pairs, slope = slopes.median_slope(rates, index, rate)
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    real = rates.select(F.col(index).cast("double").alias("i"), F.col(rate).cast("double").alias("x")).where(finite("i") & finite("x")).withColumn("all", F.lit(0))
    span = real.groupBy("all").agg((F.max("i") - F.min("i")).alias("span"))
    middle = ranks.quantiles(real, ["all"], "x", [0.5])
    one = rates.sparkSession.createDataFrame([(0, pairs, slope)], "all int, pairs long, slope double")
    drift = F.col("slope") * F.col("span") / F.col("q0") * 100
    return one.join(span, "all", "left").join(middle, "all", "left").select("pairs", "slope", drift.alias("drift_pct"))


def order_effect(pairs: DataFrame, group: str, first: str, loss: str) -> DataFrame:
    """(group, effect): median loss of pairs whose control ran first less that of the others."""
    medians = ranks.quantiles(pairs, [group, first], loss, [0.5])
    one, other = F.max(F.when(F.col(first), F.col("q0"))), F.max(F.when(~F.col(first), F.col("q0")))
    return medians.groupBy(group).agg((one - other).alias("effect"))


def speedup(runs: DataFrame, group: str, workers: str, rate: str) -> DataFrame:
    """``runs`` with speedup over the group's run of fewest workers, and efficiency per worker."""
    base = runs.groupBy(group).agg(F.min_by(rate, workers).alias("_rate"), F.min(workers).alias("_workers"))
    gain = F.col(rate) / F.col("_rate")
    return runs.join(base, group).withColumn("speedup", gain).withColumn("efficiency", gain * F.col("_workers") / F.col(workers)).drop("_rate", "_workers")


@dataclass(frozen=True)
class Policy:
    """What a gate asks of its pairs of runs; the defaults are fixed values."""

    minimum_pairs: int = 20
    samples: int = 10_000
    #: Fixed value: the seed of the resampling.
    seed: int = 0x523443484B5054
    maximum_loss: float = 10.0
    maximum_drift: float = 5.0
    maximum_order_effect: float = 5.0

    def __post_init__(self):
        limits = (self.maximum_loss, self.maximum_drift, self.maximum_order_effect)
        if self.minimum_pairs < 2 or not 1_000 <= self.samples <= 1_000_000 or not all(np.isfinite(x) and x >= 0 for x in limits):
            raise ValueError("the gate's policy is not valid")


#: Pairs that a gate may have.
PAIRS = (2, 100)


def throughput_loss(control: Column, treatment: Column) -> Column:
    """Percent of the control's rate that the treatment loses; null unless both rates are finite and above zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(good(control) & good(treatment), (1 - treatment / control) * 100)


def split_mix(states: np.ndarray) -> np.ndarray:
    """Outputs of the SplitMix64 generator at the given states."""
    with np.errstate(over="ignore"):
        x = (states ^ states >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sample_indices(seed: int, bound: int, count: int) -> np.ndarray:
    """``count`` unbiased draws from 0 to bound - 1, in the generator's order; outputs below 2^64 mod bound are passed over."""
    out, at = [], 0
    while sum(map(len, out)) < count:
        with np.errstate(over="ignore"):
            states = np.uint64(seed % 2**64) + np.arange(at + 1, at + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        drawn = split_mix(states)
        out.append(drawn[drawn >= np.uint64(2**64 % bound)] % np.uint64(bound))
        at += count
    return np.concatenate(out)[:count].astype(np.int64)


def bootstrap_interval(losses: np.ndarray, samples: int, seed: int) -> tuple[float, float]:
    """The 95 % percentile interval of the median over resamples of all losses."""
    drawn = losses[sample_indices(seed, len(losses), samples * len(losses))].reshape(samples, -1)
    low, high = np.quantile(np.median(drawn, axis=1), (0.025, 0.975))
    return float(low), float(high)


_SUMMARY = "pairs long, median_loss double, q25 double, q75 double, iqr double, mad double, ci_low double, ci_high double, drift_pct double, order_effect double, problem string"


def decide(pairs: DataFrame, gate: str, policy: Policy = Policy()) -> DataFrame:
    """One row per gate: robust statistics of its pairs' losses, the checks, and whether it passes.

    ``pairs`` has the gate, pair, control, treatment and control_first.  A gate has 2 to
    100 pairs, so one task can hold it; one with other numbers, with rates that are not
    finite and above zero, or whose two orders differ by more than one pair or are not
    known, has a problem, no statistics, and does not pass.
    """
    kind = pairs.schema[gate].dataType.simpleString()
    counted = pairs.groupBy(gate).agg(F.count("*").alias("_pairs"))
    few = pairs.join(F.broadcast(counted.where(F.col("_pairs") > PAIRS[1]).select(gate)), gate, "left_anti")

    def summary(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pair")
        row: list = [len(f), *[None] * 9, None]
        unknown = f["control_first"].isna().any()
        first = f["control_first"].fillna(False).to_numpy(bool)
        if len(f) < PAIRS[0]:
            row[-1] = "pairs"
        elif f["loss"].isna().any() or not np.isfinite(f["loss"]).all():
            row[-1] = "rates"
        elif unknown or not first.any() or first.all() or abs(2 * int(first.sum()) - len(f)) > 1:
            row[-1] = "balance"
        else:
            loss, rate = f["loss"].to_numpy(float), f["control"].to_numpy(float)
            q25, q50, q75 = np.quantile(loss, (0.25, 0.5, 0.75))
            i, j = np.triu_indices(len(rate), 1)
            drift = 100 * np.median((rate[j] - rate[i]) / (j - i)) * (len(rate) - 1) / np.median(rate)
            row[1:10] = [np.median(loss), q25, q75, q75 - q25, np.median(np.abs(loss - q50)), *bootstrap_interval(loss, policy.samples, policy.seed), drift, np.median(loss[first]) - np.median(loss[~first])]
        return pd.DataFrame([[f[gate].iloc[0], *row]], columns=[gate, *[x.split()[0] for x in _SUMMARY.split(", ")]])

    rows = few.select(gate, "pair", F.col("control").cast("double"), throughput_loss(F.col("control"), F.col("treatment")).alias("loss"), "control_first")
    made = rows.groupBy(gate).applyInPandas(summary, f"{gate} {kind}, {_SUMMARY}")
    many = counted.where(F.col("_pairs") > PAIRS[1]).select(gate, F.col("_pairs").alias("pairs"), F.lit("pairs").alias("problem"))
    c = F.col
    return made.unionByName(many, allowMissingColumns=True).select(
        "*",
        (c("pairs") >= policy.minimum_pairs).alias("enough"),
        F.coalesce(c("ci_high") < policy.maximum_loss, F.lit(False)).alias("loss_ok"),
        F.coalesce(F.abs("drift_pct") <= policy.maximum_drift, F.lit(False)).alias("drift_ok"),
        F.coalesce(F.abs("order_effect") <= policy.maximum_order_effect, F.lit(False)).alias("order_ok"),
    ).withColumn("passed", c("enough") & c("loss_ok") & c("drift_ok") & c("order_ok") & c("problem").isNull())
