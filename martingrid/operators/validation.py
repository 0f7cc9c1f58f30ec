"""Checks of block results and block universes as joins and ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.functions.codec import with_checksum
from martingrid.functions.scaled import ratio

#: Rejections that do no harm.
BENIGN = ("Duplicate", "StaleIncarnation", "StaleLease")
#: Numbers of the statuses.
STATUS_CODES = {
    "Accepted": 0, "Duplicate": 1, "InvalidRun": 2, "ExecutionLayoutMismatch": 3, "BuildMismatch": 4, "StaleIncarnation": 5, "RngVersionMismatch": 6, "StatsSchemaMismatch": 7,
    "InvalidAggregate": 8, "CorruptPayload": 9, "InvalidBlock": 10, "StaleLease": 11, "DeterminismError": 12,
}
#: Slack of the mean against minimum and maximum, in units of their scale.
MEAN_SLACK = 64 * 2.0**-52


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def invariant_error(expected: Column, n: Column, mean: Column, m2: Column, low: Column, high: Column) -> Column:
    """Why the statistics of a block can't be right, or null."""
    slack = F.greatest(F.abs(low), F.abs(high), F.lit(1.0)) * MEAN_SLACK
    return (
        F.when(~n.eqNullSafe(expected), "count")
        .when((n == 0) & ((mean != 0) | (m2 != 0) | (low != 0) | (high != 0)), "empty")
        .when(~(_finite(mean) & _finite(m2) & _finite(low) & _finite(high)), "finite")
        .when(m2 < 0, "m2")
        .when(low > high, "range")
        .when((n > 0) & ~mean.between(low - slack, high + slack), "mean")
        .when((n == 1) & ((m2 != 0) | (low != high)), "single")
    )


def _alone(results: DataFrame, run: dict, good_only: bool = False) -> DataFrame:
    """``results`` with what they decide without their block: ``_fault`` (a status or null), ``_wrong`` and ``_corrupt``; or only those that pass, whose digests alone are formed."""
    names = [c for c in results.columns if c != "status"]
    c = F.col
    differs = lambda a, b: ~c(a).eqNullSafe(b)
    wrong = invariant_error(c("n"), c("n"), c("mean"), c("m2"), c("min"), c("max")).isNotNull()
    fault = (
        F.when(differs("run_hash", run["run_hash"]), "InvalidRun")
        .when(differs("layout_hash", run["layout_hash"]), "ExecutionLayoutMismatch")
        .when(differs("build", run["build"]), "BuildMismatch")
        .when(differs("incarnation", run["incarnation"]), "StaleIncarnation")
        .when(differs("rng_version", run["rng_version"]), "RngVersionMismatch")
        .when(differs("stats_schema", run["stats_schema"]), "StatsSchemaMismatch")
    )
    rows = results.select(*names, fault.alias("_fault"), wrong.alias("_wrong"))
    if good_only:
        rows = rows.where("_fault is null and not _wrong and checksum is not null")
    corrupt = c("checksum").isNull() | differs("checksum", c("_computed"))
    rows = with_checksum(rows, "_computed").select(*names, "_fault", "_wrong", corrupt.alias("_corrupt"))
    return rows.where("not _corrupt") if good_only else rows


def _placed(alone: DataFrame, blocks: DataFrame, antithetic: bool) -> DataFrame:
    """The status of results, from what they decide alone and from their blocks."""
    names = [c for c in alone.columns if c not in ("_fault", "_wrong", "_corrupt")]
    known = blocks.select("block_id", F.col("start_scenario").alias("_start"), F.col("end_scenario").alias("_end"), F.col("lease_epoch").alias("_lease"))
    c = F.col
    differs = lambda a, b: ~c(a).eqNullSafe(b)
    observed = F.expr("(_end - _start) div 2") if antithetic else c("_end") - c("_start")
    status = (
        F.when(c("_fault").isNotNull(), c("_fault"))
        .when(c("_start").isNull() | differs("start_scenario", c("_start")) | differs("end_scenario", c("_end")), "InvalidBlock")
        .when(differs("n", observed) | c("_wrong"), "InvalidAggregate")
        .when(c("_corrupt"), "CorruptPayload")
        .when(differs("lease_epoch", c("_lease")), "StaleLease")
        .otherwise("Accepted")
    )
    return alone.join(known, "block_id", "left").select(*names, status.alias("status"))


def screen(results: DataFrame, blocks: DataFrame, run: dict, antithetic: bool = False) -> DataFrame:
    """``results`` with the column status: the first check that fails of those that need no other result, or Accepted.

    ``blocks`` has block_id, start_scenario, end_scenario and lease_epoch, a row per block
    at most.  ``run`` names the current run_hash, layout_hash, build, incarnation,
    rng_version and stats_schema.  A null fails its check.  Pairs count once.  The
    checksum is compared with the digest that is formed here from the statistics,
    whatever columns the results bring.  The lease comes last, so StaleLease says that
    all else is right.  ``results`` may be a stream.

    What a result alone decides is settled before the join, which then moves three
    columns for it in place of the statistics and digests that it was formed from.
    """
    return _placed(_alone(results, run), blocks, antithetic)


def against(status: Column, checksum: Column, done: Column) -> Column:
    """The status of a screened result whose block has the contribution ``done``, or none (null)."""
    return F.when(~status.isin("Accepted", "StaleLease") | done.isNull(), status).when(done == checksum, "Duplicate").otherwise("DeterminismError")


def with_code(judged: DataFrame) -> DataFrame:
    """The number of a status, and whether it is a rejection that does no harm."""
    codes = F.create_map(*[F.lit(x) for pair in STATUS_CODES.items() for x in pair])
    return judged.select("*", F.element_at(codes, F.col("status")).alias("code"), F.col("status").isin(*BENIGN).alias("benign"))


def validate_results(results: DataFrame, blocks: DataFrame, committed: DataFrame, run: dict, antithetic: bool = False) -> DataFrame:
    """``results`` with the columns status, code and benign: the first check that fails, or Accepted (see ``screen``).

    ``committed`` has block_id and checksum, a row per block at most.  Results are not
    compared with one another.  Both joins are equi-joins on the block; a block that gets
    very many results is left to Spark's skew join.
    """
    done = committed.select("block_id", F.col("checksum").alias("_done"))
    joined = screen(results, blocks, run, antithetic).join(done, "block_id", "left")
    return with_code(joined.withColumn("status", against(F.col("status"), F.col("checksum"), F.col("_done"))).drop("_done"))


def judge_arrivals(results: DataFrame, blocks: DataFrame, committed: DataFrame, run: dict, antithetic: bool = False) -> DataFrame:
    """``validate_results`` of results that arrive one after another: a block's first good one is accepted, later ones are held against it.

    ``results`` also has arrival, a number that no two results of a block share.  The
    first good arrival of each block is found by an aggregate that combines before the
    shuffle, so a block with very many results costs no more than others; it reads only
    the results that pass all checks of their own.
    """
    screened = screen(results, blocks, run, antithetic)
    good = _placed(_alone(results, run, good_only=True), blocks, antithetic)
    first = good.where("status = 'Accepted'").groupBy("block_id").agg(F.min("arrival").alias("_at"), F.min_by("checksum", "arrival").alias("_first"))
    done = committed.select("block_id", F.col("checksum").alias("_done"))
    joined = screened.join(first, "block_id", "left").join(done, "block_id", "left")
    before = F.coalesce(F.col("_done"), F.when(F.col("arrival") > F.col("_at"), F.col("_first")))
    return with_code(joined.withColumn("status", against(F.col("status"), F.col("checksum"), before)).drop("_at", "_first", "_done"))


def missing_blocks(blocks: DataFrame, committed: DataFrame) -> DataFrame:
    return blocks.join(committed.select("block_id"), "block_id", "left_anti")


def orphan_results(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Results that no manifest entry names."""
    key = ["block_id", "incarnation", "lease_epoch"]
    return results.join(manifest.select(*key), key, "left_anti")


def universe_gaps(blocks: DataFrame) -> DataFrame:
    """(block_id, end_scenario, next_start, problem) of blocks whose successor does not start where they end, or is not there.

    Neighbours meet in an equi-join on the id, so no task sorts the whole universe as a
    window would.  The last block needs no successor.
    """
    after = blocks.select((F.col("block_id") - 1).alias("block_id"), F.col("start_scenario").alias("next_start"))
    last = F.broadcast(blocks.agg(F.max("block_id").alias("_last")).where("_last is not null"))
    gap = F.when(F.col("next_start") > F.col("end_scenario"), "gap").when(F.col("next_start") < F.col("end_scenario"), "overlap").when(F.col("next_start").isNull() & F.col("_last").isNull(), "hole")
    ends = blocks.join(last, F.col("block_id") == F.col("_last"), "left").select("block_id", "end_scenario", "_last")
    return ends.join(after, "block_id", "left").select("block_id", "end_scenario", "next_start", gap.alias("problem")).where("problem is not null")


def universe_problems(blocks: DataFrame, scenarios: int, block_size: int, antithetic: bool = False) -> DataFrame:
    """(block_id, problem) of everything that keeps ``blocks`` from being the universe of a run.

    ``blocks`` has block_id, start_scenario, end_scenario, incarnation and lease_epoch.
    Ranges follow from the id, so each row is checked alone; only repeats and missing
    ids need a shuffle, of ids.  The incarnation is to be the least one throughout.
    """
    c, n = F.col, 1 + (scenarios - 1) // block_size
    first = blocks.agg(F.min("incarnation")).first()[0]
    start, end = c("block_id") * block_size, F.least((c("block_id") + 1) * block_size, F.lit(scenarios))
    odd = (c("start_scenario") % 2 != 0) | (c("end_scenario") % 2 != 0)
    problem = (
        F.when(~F.coalesce(c("block_id").between(0, n - 1), F.lit(False)), "outside")
        .when(~c("start_scenario").eqNullSafe(start) | ~c("end_scenario").eqNullSafe(end), "range")
        .when(~c("incarnation").eqNullSafe(F.lit(first)), "incarnation")
        .when(~F.coalesce(c("lease_epoch") >= 1, F.lit(False)), "lease")
        .when(odd if antithetic else F.lit(False), "pair")
    )
    rows = blocks.select("block_id", problem.alias("problem")).where("problem is not null")
    again = blocks.groupBy("block_id").count().where("count > 1").select("block_id", F.lit("repeated").alias("problem"))
    absent = blocks.sparkSession.range(n).select(c("id").alias("block_id")).join(blocks.select("block_id"), "block_id", "left_anti").select("block_id", F.lit("missing").alias("problem"))
    return rows.unionByName(again).unionByName(absent)


def spec_problem(rows: DataFrame) -> Column:
    """Why a row of specifications can't be run, first reason first, or null; columns are named as the fields of RunSpec."""
    c = F.col
    good = lambda x: _finite(c(x)) & (c(x) > 0)
    positive = lambda x: F.coalesce(good(x), F.lit(False))
    not_negative = lambda x: F.coalesce(_finite(c(x)) & (c(x) >= 0), F.lit(False))
    stochastic = c("model") == "heston"
    return (
        F.when(~F.coalesce(c("scenarios").between(1, 1 << 40), F.lit(False)), "scenarios")
        .when(~F.coalesce(c("steps").between(1, 1 << 24), F.lit(False)), "steps")
        .when(~positive("maturity"), "maturity").when(~positive("spot"), "spot").when(~positive("strike"), "strike")
        .when(~F.coalesce(_finite(c("rate")), F.lit(False)), "rate")
        .when(~F.coalesce(c("model").isin("gbm", "heston"), F.lit(False)), "model")
        .when((c("model") == "gbm") & ~positive("volatility"), "volatility")
        .when(stochastic & ~(not_negative("initial_variance") & not_negative("reversion") & not_negative("long_variance") & not_negative("variance_volatility")), "variance")
        .when(stochastic & ~F.coalesce(_finite(c("correlation")) & c("correlation").between(-1, 1), F.lit(False)), "correlation")
        .when(~F.coalesce(c("payoff").isin("european_call", "asian_call"), F.lit(False)), "payoff")
        .when(F.coalesce(c("antithetic"), F.lit(False)) & ((c("scenarios") % 2 != 0) | F.coalesce(c("block_size") % 2 != 0, F.lit(True))), "pairs")
    )


def feller_ratio(kappa: Column, theta: Column, xi: Column) -> Column:
    """2 * kappa * theta / xi^2 with exponents apart, so that no step overflows; infinite for xi 0, NaN for bad parameters."""
    good = _finite(kappa) & _finite(theta) & _finite(xi) & (kappa >= 0) & (theta >= 0) & (xi >= 0)
    value = ratio([F.lit(2.0), kappa, theta], [xi, xi])
    return F.when(~F.coalesce(good, F.lit(False)), float("nan")).when(xi == 0, float("inf")).when((kappa == 0) | (theta == 0), 0.0).otherwise(value)
