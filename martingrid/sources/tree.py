"""The reduction tree of a run as a table of nodes, which commits add to.

Node (level, position) holds the statistics of the blocks position * 2^level up to
(position + 1) * 2^level; it is there once all of them are.  A commit adds its leaves
and the nodes that they complete: the inner ones of its own blocks, formed in tasks of
``2^CHUNK`` neighbouring blocks, and about one a level above, formed on the driver from
their children, which are looked up by level and position.  So a commit of b blocks
writes 2 b + log n rows, whatever was there before, and the last one writes the root.
One job writes several commits; each has the nodes that are complete once it is there.
A level's odd last node goes up as it is, so positions, and with them all bits of the
result, are those of the tree over all leaves at once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from martingrid.functions.codec import with_checksum
from martingrid.operators.simulate import merge_stats

#: Levels within a chunk, which one task goes through.
CHUNK = 10
VALUES = ("n", "mean", "m2", "min", "max")
NODE = "level int, position long, n long, mean double, m2 double, min double, max double"
_OWNED = f"{NODE}, sequence long"
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def width(n_blocks: int, level: int) -> int:
    """How many nodes a level has."""
    return -(-n_blocks >> level) if level == 0 else (n_blocks + (1 << level) - 1) >> level


def height(n_blocks: int) -> int:
    """The level of the root."""
    return (n_blocks - 1).bit_length()


def grown(known: dict, fresh: set, n_blocks: int, top: int) -> list[tuple[int, int]]:
    """The nodes up to level ``top`` that ``fresh`` ones complete; they are added to ``known``, (level, position) to statistics."""
    made, at = [], {}
    for level, position in fresh:
        at.setdefault(level, set()).add(position)
    for level in range(top):
        size = width(n_blocks, level)
        for p in sorted({x >> 1 for x in at.get(level, ())}):
            left, right = known.get((level, 2 * p)), known.get((level, 2 * p + 1))
            if left is None or right is None and 2 * p + 1 < size or (level + 1, p) in known:
                continue
            known[level + 1, p] = left if right is None else merge_stats(left, right)
            at.setdefault(level + 1, set()).add(p)
            made.append((level + 1, p))
    return made


def _claimed(made: list[tuple[int, int]], owner: dict) -> None:
    """Adds inner nodes, lower levels first, to ``owner``: a node is of the latest commit that brought something under it."""
    for level, p in made:
        owner[level, p] = max(owner.get((level - 1, 2 * p), 0), owner.get((level - 1, 2 * p + 1), 0))


def _chunks(rows: DataFrame, n_blocks: int, top: int) -> DataFrame:
    """Fresh leaves, and the nodes within chunks that they complete; rows have the columns of nodes and ``sequence``, 0 for what was there before."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        known = {(int(k), int(p)): tuple(v) for k, p, *v in part[_NAMES].itertuples(index=False, name=None)}
        owner = {(int(k), int(p)): int(s) for k, p, s in part.loc[part["sequence"] > 0, ["level", "position", "sequence"]].itertuples(index=False, name=None)}
        leaves = sorted(owner)
        made = grown(known, set(owner), n_blocks, top)
        _claimed(made, owner)
        return pd.DataFrame([(*at, *known[at], owner[at]) for at in (*leaves, *made)], columns=[*_NAMES, "sequence"])

    chunk = F.expr(f"position >> ({CHUNK} - level)").alias("chunk")
    return rows.groupBy(chunk).applyInPandas(run, _OWNED)


def _read(spark: SparkSession, folder: str, sequences: list[int]) -> DataFrame:
    """The nodes that the given commits added, with their sequence."""
    if not sequences:
        return spark.createDataFrame([], _OWNED)
    return spark.read.schema(_OWNED).option("basePath", f"{folder}/tree").parquet(*[f"{folder}/tree/sequence={s}" for s in sequences])


def add(spark: SparkSession, folder: str, sequence: int, leaves: DataFrame, n_blocks: int, before: list[int]) -> None:
    """Writes what a commit adds: ``leaves`` (block_id and statistics) and the nodes that they complete with those of the commits ``before``."""
    add_each(spark, folder, leaves.withColumn("sequence", F.lit(sequence)), n_blocks, before, before)


def add_each(spark: SparkSession, folder: str, leaves: DataFrame, n_blocks: int, near: list[int], above: list[int]) -> set[int]:
    """Writes what several commits add, in the order of the column ``sequence`` of ``leaves``; gives those that add nodes above the chunks.

    Of earlier commits only those named are read: ``near`` for nodes within the chunks
    of these leaves, ``above`` for nodes from the chunks' tops on.
    """
    top, inner = height(n_blocks), min(CHUNK, height(n_blocks))
    low, high, first, last = leaves.agg(F.min("block_id"), F.max("block_id"), F.min("sequence"), F.max("sequence")).first()
    if low is None:
        return set()
    low, high, cores = low >> CHUNK, high >> CHUNK, spark.sparkContext.defaultParallelism
    within = _read(spark, folder, near).where(f"level <= {inner}").where(F.expr(f"position >> ({CHUNK} - level)").between(low, high))
    fresh = leaves.select(F.lit(0).alias("level"), F.col("block_id").alias("position"), *VALUES, F.col("sequence").cast("long"))
    rows = fresh.unionByName(within.withColumn("sequence", F.lit(0).cast("long")))
    tasks = min(cores, last - first + 1)
    written = _chunks(rows, n_blocks, inner).repartition(tasks, "sequence").write.partitionBy("sequence").option("partitionOverwriteMode", "dynamic")
    written.mode("overwrite").parquet(f"{folder}/tree")  # without its head, what is there does not count
    if top <= CHUNK:
        return set()
    own = [r[0] for r in leaves.select(F.col("sequence").cast("long")).distinct().orderBy("sequence").collect()]
    tops = _read(spark, folder, own).where(f"level = {CHUNK}").collect()  # a node for 1,024 blocks
    owner = {(r.level, r.position): r.sequence for r in tops}
    # positions beside the fresh nodes and their ancestors: what may complete them
    wanted = [(F.col("level") == k) & F.col("position").between((low >> (k - CHUNK)) - 1, (high >> (k - CHUNK)) + 1) for k in range(CHUNK, top + 1)]
    known = _known(_read(spark, folder, above).where(reduce(or_, wanted)).collect()) | _known(tops)
    made = grown(known, set(owner), n_blocks, top)
    _claimed(made, owner)
    if made:
        spark.createDataFrame([(*at, *known[at], owner[at]) for at in made], _OWNED).coalesce(1).write.partitionBy("sequence").mode("append").parquet(f"{folder}/tree")
    return set(owner.values())


def _known(nodes: list[Row]) -> dict:
    return {(r.level, r.position): tuple(r[c] for c in VALUES) for r in nodes}


def root(spark: SparkSession, folder: str, sequences: list[int], n_blocks: int) -> tuple | None:
    """The statistics of the whole run; none before all its blocks are there."""
    found = _read(spark, folder, sequences).where((F.col("level") == height(n_blocks)) & (F.col("position") == 0)).first()
    return None if found is None else tuple(found[c] for c in VALUES)


def from_leaves(spark: SparkSession, leaves: DataFrame, n_blocks: int) -> DataFrame:
    """All nodes that ``leaves`` complete, formed anew: chunks in tasks, then chunks of their tops, up to the root."""
    parts, level, size = [], 0, n_blocks
    rows = leaves.select(F.lit(0).alias("level"), F.col("block_id").alias("position"), *VALUES)
    while True:
        inner = min(CHUNK, height(size))
        made = _chunks(rows.withColumn("sequence", F.lit(1).cast("long")), size, inner).drop("sequence")
        parts.append(made.where("level > 0" if level else "level >= 0").withColumn("level", F.col("level") + level))
        if height(size) <= CHUNK:
            break
        rows = made.where(f"level = {CHUNK}").withColumn("level", F.lit(0))
        level, size = level + CHUNK, width(size, CHUNK)
    return reduce(DataFrame.unionByName, parts)


def _bits(nodes: DataFrame) -> Column:
    return with_checksum(nodes, "bits").select("level", "position", "bits")


def differing(spark: SparkSession, folder: str, sequences: list[int], leaves: DataFrame, n_blocks: int) -> DataFrame:
    """(level, position) of nodes that are not, bit by bit, what ``leaves`` make of them, are missing, superfluous or repeated."""
    stored = _bits(_read(spark, folder, sequences)).groupBy("level", "position").agg(F.count("*").alias("times"), F.min("bits").alias("bits"))
    right = _bits(from_leaves(spark, leaves, n_blocks)).withColumnRenamed("bits", "right")
    both = stored.join(right, ["level", "position"], "full")
    return both.where(~F.col("bits").eqNullSafe(F.col("right")) | ~F.col("times").eqNullSafe(F.lit(1))).select("level", "position")
