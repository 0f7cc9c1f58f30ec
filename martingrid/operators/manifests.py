"""The newest valid manifest of each run, as joins and aggregates over all runs at once.

A manifest is a head and the entries that it lists.  Entries are compared with their
neighbours by a join on the place, not by a window, so a manifest of any length is
spread over tasks; what is wrong with a manifest is summed up before its head is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the version of the format that can be read.
SCHEMA = 1


def _at_least(c: str, low: int) -> Column:
    return F.coalesce(F.col(c) >= low, F.lit(False))


def entry_problem() -> Column:
    """Why an entry is not canonical, first reason first, or null.

    Reads place, block_id, result_incarnation, lease_epoch, the manifest's incarnation
    and block_count, the block's high_water lease, and the id before it, previous_id.
    """
    c = F.col
    return (
        F.when(~(_at_least("block_id", 0) & F.coalesce(c("block_id") < c("block_count"), F.lit(False))), "outside")
        .when(~(_at_least("result_incarnation", 1) & F.coalesce(c("result_incarnation") <= c("incarnation"), F.lit(False))), "incarnation")
        .when(~(_at_least("lease_epoch", 1) & F.coalesce(c("lease_epoch") <= c("high_water"), F.lit(False))), "lease")
        .when((c("result_incarnation") == c("incarnation")) & (c("lease_epoch") != c("high_water")), "current lease")
        .when((c("place") > 0) & ~F.coalesce(c("previous_id") < c("block_id"), F.lit(False)), "order")
    )


def manifest_problems(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """``heads`` with ``problem``: why a manifest is not valid, or null.

    ``heads`` has run, sequence, schema, incarnation, block_count and committed, once for
    each run and sequence; ``entries`` has run, sequence, place (counting from 0),
    block_id, result_incarnation, lease_epoch and high_water.  Places that are missing,
    repeated or beyond ``committed`` are damage, as is an entry that is not canonical;
    the least place's problem is told, of equal places the first in alphabetical order.
    Entries without a head count for nothing, a head without entries is valid if it
    commits none.
    """
    c, key = F.col, ["run", "sequence"]
    before = entries.select("run", "sequence", (c("place") + 1).alias("place"), c("block_id").alias("_id")).groupBy(*key, "place").agg(F.max("_id").alias("previous_id"))
    each = entries.join(before, [*key, "place"], "left").join(heads.select(*key, "incarnation", "block_count", "committed"), key)
    problem = F.when(~F.coalesce(c("place").between(0, c("committed") - 1), F.lit(False)), "place").otherwise(entry_problem())
    judged = each.select(*key, "place", problem.alias("p"))
    places = judged.groupBy(*key, "place").agg(F.count("*").alias("times"), F.min("p").alias("p"))
    told = F.when(c("times") > 1, "repeated").otherwise(c("p"))
    summed = places.withColumn("p", told).groupBy(*key).agg(F.count("*").alias("_places"), F.min(F.when(c("p").isNotNull(), F.struct("place", "p")))["p"].alias("_p"))
    found = heads.join(summed, key, "left")
    short = ~F.coalesce(c("_places"), F.lit(0)).eqNullSafe(c("committed"))
    return found.select(*heads.columns, F.coalesce("_p", F.when(short, "missing")).alias("problem"))


def latest_valid_manifests(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """(run, sequence, newest, committed, skipped) of each run that has a valid manifest.

    ``sequence`` is the greatest valid one, ``newest`` the greatest of all, ``skipped``
    how many newer ones are damaged.  Damage alone lets an older manifest stand in: a
    format that this cannot read, or two heads of one sequence, raises, for going on from
    an older state then would lose what the newer one holds.
    """
    c = F.col
    checked = manifest_problems(heads, entries)
    policy = F.when(~c("schema").eqNullSafe(F.lit(SCHEMA)), F.raise_error(F.concat(F.lit("manifest of an unknown format, run "), c("run").cast("string"))))
    checked = checked.withColumn("problem", F.coalesce(policy.cast("string"), c("problem")))
    once = checked.groupBy("run", "sequence").agg(F.count("*").alias("heads"), F.max("problem").alias("problem"), F.max("committed").alias("committed"))
    twice = F.when(c("heads") > 1, F.raise_error(F.concat(F.lit("two manifests of one sequence, run "), c("run").cast("string"))))
    judged = once.select("run", "sequence", "committed", F.coalesce(twice.cast("string"), c("problem")).alias("problem"))
    best = judged.groupBy("run").agg(F.max("sequence").alias("newest"), F.max(F.when(c("problem").isNull(), F.struct("sequence", "committed"))).alias("best"))
    valid = best.where("best is not null").select("run", "best.sequence", "newest", "best.committed")
    damaged = judged.where("problem is not null").select("run", c("sequence").alias("_s"))
    counted = valid.join(damaged, "run", "left").groupBy("run", "sequence", "newest", "committed").agg(F.count_if(c("_s") > c("sequence")).alias("skipped"))
    return counted
