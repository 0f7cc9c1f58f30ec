"""Exact order statistics per group, whose work is spread over ranges of values, so that no task holds a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of about equal numbers of distinct (group, value) rows; a task sorts one group's part of one range.
RANGES = 256
#: A value's range is looked up among every so many of the ranges, then among those between.
STRIDE = 16

Rank = Callable[[Column], Column]


def values_at(rows: DataFrame, groups: Sequence[str], value: str, ranks: Sequence[Rank], times: str | None = None) -> DataFrame:
    """(groups, total, v0, v1, ...): the group's number of values, and its values at the given ranks.

    A rank is a function of the total and counts from 1.  A row stands for as many
    values as its column ``times`` says, or for one.  Nulls are no values; a group
    of nulls alone has total 0 and nulls.  A null group is a group like any other, and
    NaN is above all numbers.  Equal values are counted before anything else is done
    with them, so a frequent value costs no more than a rare one.
    """
    c = F.col
    counts = rows.groupBy(*groups, c(value).alias("_value")).agg(F.count(value).alias("_times") if times is None else F.sum(F.when(c(value).isNull(), 0).otherwise(c(times))).alias("_times"))
    splits = counts.agg(F.percentile_approx("_value", [i / RANGES for i in range(1, RANGES)], 64 * RANGES).alias("_splits"))
    one = splits.withColumn("_coarse", F.filter("_splits", lambda _, i: (i + 1) % STRIDE == 0))  # one row
    below = lambda xs: F.size(F.filter(xs, lambda x: x < c("_value")))
    near = counts.join(F.broadcast(one)).withColumn("_near", below(c("_coarse")) * STRIDE)
    ranged = near.withColumn("_range", F.coalesce(c("_near") + below(F.slice("_splits", c("_near") + 1, F.lit(STRIDE))), F.lit(0))).drop("_splits", "_coarse", "_near")

    whole = Window.partitionBy(*groups)
    sizes = ranged.groupBy(*groups, "_range").agg(F.sum("_times").alias("_size"))
    placed = sizes.select(*groups, "_range", "_size", (F.sum("_size").over(whole.orderBy("_range")) - c("_size")).alias("_before"), F.sum("_size").over(whole).alias("total"))

    def within(below: Column, upto: Column) -> list[Column]:
        return [(rank(c("total")) > below) & (rank(c("total")) <= upto) for rank in ranks]

    empty = c("total") == 0
    wanted = placed.where(reduce(or_, within(c("_before"), c("_before") + c("_size")), empty)).select(
        *[c(g).alias(f"_group{i}") for i, g in enumerate(groups)], c("_range").alias("_wanted"), "_before", "total"
    )
    same = reduce(and_, [c(g).eqNullSafe(c(f"_group{i}")) for i, g in enumerate(groups)], c("_range") == c("_wanted"))
    inside = Window.partitionBy(*groups, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(wanted, same).withColumn("_upto", c("_before") + F.sum("_times").over(inside))
    hits = within(c("_upto") - c("_times"), c("_upto"))
    found = [F.max(F.when(hit, c("_value"))).alias(f"v{i}") for i, hit in enumerate(hits)]
    return upto.where(reduce(or_, hits, empty)).groupBy(*groups).agg(F.max("total").alias("total"), *found)


def nearest(p: float) -> Rank:
    """The least rank whose share of the total is ``p`` or more."""

    def rank(total: Column) -> Column:
        up = F.greatest(F.ceil(total * F.lit(p)), F.lit(1))
        return F.when((up > 1) & ((up - 1) / total >= p), up - 1).otherwise(up)

    return rank


def quantiles(rows: DataFrame, groups: Sequence[str], value: str, at: Sequence[float], times: str | None = None) -> DataFrame:
    """(groups, total, q0, q1, ...): quantiles as doubles, interpolated between the neighbours of p * (total - 1)."""
    ranks = [r for p in at for r in (lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1, lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1)]
    found = values_at(rows.withColumn(value, F.col(value).cast("double")), groups, value, ranks, times)

    def between(i: int, p: float) -> Column:
        low, high, place = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), (F.col("total") - 1) * F.lit(p)
        part = place - F.floor(place)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(f"q{i}")

    return found.select(*groups, "total", *[between(i, p) for i, p in enumerate(at)])
