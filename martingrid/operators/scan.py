"""Prefix sums and interval sets over ordered rows, whose work is spread over ranges of the order.

A running total needs the rows before a row, wherever they are.  The order is cut into
ranges of about equal numbers of rows; each range is scanned on its own, and what a
range hands on (its sum since its last reset, or its outermost interval) is one row, so
that a scan over all ranges is a scan over at most ``RANGES`` rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martingrid.sources.shared import kept

#: Ranges of the order; a task sorts one group's part of one range.
RANGES = 256
#: A value's range is looked up among every so many of the cuts, then among those between.
STRIDE = 16


def with_range(rows: DataFrame, order: str, name: str = "_range") -> DataFrame:
    """``rows`` with the number of their range, rising with the column ``order``; nulls are in the first range.

    The cuts between the ranges come from one pass over the column, and go to all tasks as one row.
    """
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 64 * RANGES)).first()[0] or []))
    kind = rows.schema[order].dataType
    one = rows.sparkSession.createDataFrame([(cuts, cuts[STRIDE - 1 :: STRIDE])], f"_cuts array<{kind.simpleString()}>, _coarse array<{kind.simpleString()}>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(order)))
    near = rows.join(F.broadcast(one)).withColumn("_near", below(F.col("_coarse")) * STRIDE)
    at = F.coalesce(F.col("_near") + below(F.slice("_cuts", F.col("_near") + 1, F.lit(STRIDE))), F.lit(0))
    return near.withColumn(name, at).drop("_cuts", "_coarse", "_near")


def _handed_on(summaries: DataFrame, groups: Sequence[str], kind: str, start: Column, step) -> DataFrame:
    """(groups, _range, _in): for each range what the ranges before it leave, by ``step(state, summary)`` from ``start``, of the type ``kind``.

    A group has at most RANGES summaries, so they are one array, gone through once.
    """
    rest = [c for c in summaries.columns if c not in (*groups, "_range")]
    ordered = summaries.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_range", *rest))).alias("_all"))
    begin = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<struct<_range:int,_in:{kind}>>").alias("out"))

    def onward(acc: Column, s: Column) -> Column:
        return F.struct(step(acc["state"], s).cast(kind).alias("state"), F.concat(acc["out"], F.array(F.struct(s["_range"].alias("_range"), acc["state"].alias("_in")))).alias("out"))

    return ordered.select(*groups, F.inline(F.aggregate("_all", begin, onward, lambda acc: acc["out"])))


def _joined(rows: DataFrame, carried: DataFrame, groups: Sequence[str]) -> DataFrame:
    renamed = carried.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_at"), "_in")
    on = F.col("_range") == F.col("_at")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(renamed, on).drop("_at", *[f"_g{i}" for i in range(len(groups))])


def since_reset(rows: DataFrame, order: str, amount: Column, reset: Column, groups: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``since`` and ``resets``: the sum of ``amount`` from the last reset on, and how many resets there were.

    A reset row starts anew: its own amount is the first of the new sum, and it counts as
    a reset; rows before the first one count from the start.  ``amount`` is taken as a
    long, so sums are exact; a null amount is zero, a null reset none.  Rows are ordered
    by ``order`` within their group, nulls first; where it repeats, the order of the
    equal rows is not defined, so make it unique.  An empty table stays empty.
    """
    c = F.col
    marked = with_range(rows.withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0))).withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("long")), order)
    w = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_sum", F.sum("_amount").over(w)).withColumn("_seen", F.sum("_reset").over(w))
    local = local.withColumn("_base", F.last(F.when(c("_reset") == 1, c("_sum") - c("_amount")), ignorenulls=True).over(w))
    tail = F.sum("_amount") - F.coalesce(F.max_by("_base", F.when(c("_seen") > 0, c("_seen"))), F.lit(0))
    summary = local.groupBy(*groups, "_range").agg(tail.alias("tail"), F.max("_seen").alias("n"))
    state = F.struct(F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("n"))
    carried = _handed_on(summary, groups, "struct<tail:bigint,n:bigint>", state, lambda s, x: F.struct((F.when(x["n"] > 0, F.lit(0)).otherwise(s["tail"]) + x["tail"]).alias("tail"), (s["n"] + x["n"]).alias("n")))
    done = _joined(local, carried, groups)
    since = F.when(c("_seen") > 0, c("_sum") - c("_base")).otherwise(c("_in.tail") + c("_sum"))
    return done.select(*rows.columns, since.alias("since"), (c("_in.n") + c("_seen")).alias("resets"))


def intervals(ids: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, first, last, ids, rows): the runs of neighbouring whole numbers in a column.

    ``ids`` is the number of different ids of a run, ``rows`` that of rows; the set has
    each id once exactly if both agree everywhere.  Repeated rows and any order are
    allowed, nulls are no ids.  Runs are formed inside ranges of ids first; only their
    outermost ones can go on in the next range, so ranges meet as one row each.
    """
    c = F.col
    counted = ids.where(c(column).isNotNull()).groupBy(*groups, c(column).cast("long").alias("_id")).agg(F.count("*").alias("_rows"))
    inside = Window.partitionBy(*groups, "_range").orderBy("_id")
    ranged = with_range(kept(counted), "_id").withColumn("_run", c("_id") - F.row_number().over(inside))
    parts = ranged.groupBy(*groups, "_range", "_run").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.sum("_rows").alias("rows"))
    return union(parts.select(*groups, "first", "last", "rows"), groups)


def union(parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, first, last, ids, rows) of intervals (groups, first, last, and rows if it is there) that may overlap or meet.

    A run starts where an interval begins after the end of all before it; that end comes
    from a scan over ranges of beginnings.  Intervals with a null, or that end before
    they begin, are empty.
    """
    c = F.col
    if "rows" not in parts.columns:
        parts = parts.withColumn("rows", c("last") - c("first") + 1)
    once = parts.where("first <= last").groupBy(*groups, "first", "last").agg(F.sum("rows").alias("rows"))  # so that their order is one
    real = kept(with_range(kept(once), "first"))
    w = Window.partitionBy(*groups, "_range").orderBy("first", "last")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = real.groupBy(*groups, "_range").agg(F.max("last").alias("end"))
    carried = _handed_on(ends, groups, "bigint", F.lit(None), lambda s, x: F.greatest(s, x["end"]))
    reached = _joined(real.withColumn("_end", F.max("last").over(before)), carried, groups).withColumn("_end", F.greatest("_end", "_in")).drop("_in")
    begins = (c("_end").isNull() | (c("first") > c("_end") + 1)).alias("_begins")
    # the beginnings' order within a range is kept by a number of their own
    numbered = kept(reached.withColumn("_begins", begins.cast("long")).withColumn("_seen", F.sum(c("_begins")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    starts = numbered.groupBy(*groups, "_range").agg(F.sum("_begins").alias("n"))
    totals = _handed_on(starts, groups, "bigint", F.lit(0), lambda s, x: s + x["n"])
    runs = _joined(numbered, totals, groups).withColumn("_run", c("_in") + c("_seen"))
    made = runs.groupBy(*groups, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"))
    return made.select(*groups, "first", "last", (c("last") - c("first") + 1).alias("ids"), "rows")


def difference(whole: DataFrame, less: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, first, last): what ids of the intervals ``whole`` are in none of ``less``.

    Ends of both sets are points at which a depth changes; depths are sums over all
    points before, from a scan over ranges of points.  Between two neighbouring points
    the ids are wanted where ``whole`` covers them and ``less`` does not.
    """
    c, points = F.col, []
    for rows, kind in ((whole, "_w"), (less, "_l")):
        real = rows.where("first <= last")
        other = "_l" if kind == "_w" else "_w"
        for at, change in (("first", 1), ("last", -1)):
            points.append(real.select(*groups, (c(at) + F.lit(1 if at == "last" else 0)).alias("_point"), F.lit(change).cast("long").alias(kind), F.lit(0).cast("long").alias(other)))
    every = points[0]
    for p in points[1:]:
        every = every.unionByName(p)
    summed = kept(with_range(kept(every.groupBy(*groups, "_point").agg(F.sum("_w").alias("_w"), F.sum("_l").alias("_l"))), "_point"))
    w = Window.partitionBy(*groups, "_range").orderBy("_point")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ends = summed.groupBy(*groups, "_range").agg(F.min("_point").alias("start"), F.sum("_w").alias("w"), F.sum("_l").alias("l"))
    state = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("l"))
    carried = _handed_on(ends.drop("start"), groups, "struct<w:bigint,l:bigint>", state, lambda s, x: F.struct((s["w"] + x["w"]).alias("w"), (s["l"] + x["l"]).alias("l")))
    # a range's last point ends where the next range that has points starts
    starts = ends.select(*groups, "_range", "start")
    after = starts.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_range", "start"))).alias("_all"))
    nexts = after.select(*groups, F.inline(F.transform("_all", lambda s, i: F.struct(s["_range"].alias("_range"), F.get("_all", i + 1)["start"].alias("_in")))))
    deep = summed.withColumn("_w", F.sum("_w").over(upto)).withColumn("_l", F.sum("_l").over(upto)).withColumn("_next", F.lead("_point").over(w))
    deep = _joined(deep, carried, groups).select(*deep.columns, (c("_w") + c("_in.w")).alias("_dw"), (c("_l") + c("_in.l")).alias("_dl"))
    deep = _joined(deep, nexts, groups).withColumn("_next", F.coalesce("_next", "_in"))
    return union(deep.where("_dw > 0 and _dl = 0").select(*groups, c("_point").alias("first"), (c("_next") - 1).alias("last")), groups).select(*groups, "first", "last")


def exactly_once(parts: DataFrame, universe: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row (groups, blocks, missing, outside, repeated, covered) for each group of either side.

    ``parts`` are intervals (groups, first, last, rows) that together should be the
    intervals ``universe``, each id once: ``missing`` and ``outside`` count ids that only
    one side has, ``repeated`` rows beyond the first of their id.  All are sums over
    intervals, so dense ids cost a few rows, however many there are.
    """
    c = F.col
    have, universe = kept(union(parts, groups)), kept(universe)
    size = lambda rows, name: rows.select(*groups, (c("last") - c("first") + 1).alias(name))
    counts = [
        have.select(*groups, c("rows").alias("blocks"), (c("rows") - c("ids")).alias("repeated")),
        size(difference(universe, have, groups), "missing"),
        size(difference(have, universe, groups), "outside"),
        universe.select(*groups).distinct() if groups else universe.limit(0).select(),
    ]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    summed = every.groupBy(*groups).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("blocks", "missing", "outside", "repeated")])
    return summed.withColumn("covered", (c("missing") == 0) & (c("outside") == 0) & (c("repeated") == 0))
