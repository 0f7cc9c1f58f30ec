"""Durable, resumable runs as Parquet: results by batch, and manifests that name what is committed.

A run's folder has ``metadata`` (what the run is), ``results`` (statistics of blocks, by
incarnation and batch), ``entries`` (the blocks that a manifest adds to those of its
base), ``tree`` (the reduction's nodes that it adds) and ``heads`` (one row a manifest,
written last, so a manifest without one does not count).  A batch writes rows in
proportion to its own blocks.  Neighbouring batches are computed and committed together,
a manifest each, up to WAVE steps of paths (of a large batch, one by one), so small
batches cost no jobs of their own; a batch whose jobs are lost is computed again, and a
result counts once a manifest names it.  Only the driver's run writes manifests: give one
run at a time a folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from martingrid.functions import codec
from martingrid.operators.simulate import RunSpec, block_stats, blocks
from martingrid.operators.validation import validate_results
from martingrid.sources import tree
from martingrid.sources.shared import shared_root

#: What computes the statistics; results of another kernel are not mixed in.
BUILD = "numpy-kernel-2"
RUNNING, COMPLETED, FAILED = "Running", "Completed", "Failed"
#: Steps of paths, and batches, that are computed and committed together.
WAVE, WAVE_BATCHES = 1 << 24, 1024
_ENTRY = "block_id long, incarnation long, lease_epoch long, checksum string"
_HEAD = "run_id string, sequence long, base long, status string, incarnation long, lease_epoch long, committed long, added long, digest string, n long, mean double, m2 double, min double, max double, reason string"


class RunError(RuntimeError):
    """The folder belongs to another run, or its run has failed."""


@dataclass(frozen=True)
class Head:
    """A manifest without its entries."""

    run_id: str
    sequence: int
    #: The manifest to whose entries this one adds; 0 for none.
    base: int
    status: str
    incarnation: int
    lease_epoch: int
    #: Entries of its whole chain, and of its own.
    committed: int
    added: int = 0
    digest: str = ""
    n: int | None = None
    mean: float | None = None
    m2: float | None = None
    min: float | None = None
    max: float | None = None
    reason: str | None = None


def new_folder(spark: SparkSession) -> str:
    """An unused folder where all executors can write: under spark.checkpoint.dir, or a temporary one on a single machine."""
    return f"{shared_root(spark)}/run-{uuid.uuid4().hex}"


#: What Spark says of a path that is not there, or empty.
_LOST = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
#: What it says of a file that is not what it should be.
_UNREADABLE = "FAILED_READ_FILE"


def _read(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    """The table at the paths; none where one is not there."""
    try:
        return (spark.read.option("basePath", base) if base else spark.read).parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() in _LOST:
            return None
        raise


#: Neighbouring block ids whose entries are digested together.
DIGESTED = 1 << 16
ENTRY = ("block_id", "incarnation", "lease_epoch", "checksum")


def _digests(entries: DataFrame) -> dict[int, tuple[int, str]]:
    """By sequence: how many entries a manifest adds, and their SHA-256, formed in order of ids range by range.

    A range of ids is one row on the driver, so a row for 65,536 entries.
    """
    line = F.concat_ws(" ", F.lpad(F.col("block_id").cast("string"), 20, "0"), "incarnation", "lease_epoch", F.coalesce("checksum", F.lit("-")))
    parts = entries.groupBy("sequence", F.expr(f"block_id div {DIGESTED}").alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    out: dict[int, tuple[int, list[str]]] = {}
    for r in parts.orderBy("sequence", F.col("part").asc_nulls_first()).collect():
        n, lines = out.get(r.sequence, (0, []))
        out[r.sequence] = (n + r.n, [*lines, r.d])
    return {s: (n, hashlib.sha256("\n".join(lines).encode()).hexdigest()) for s, (n, lines) in out.items()}


def chain(known: list[Head], head: Head) -> list[Head] | None:
    """The manifests whose entries together are those of ``head``, oldest first; none if one is missing."""
    by, out = {h.sequence: h for h in known}, [head]
    while out[-1].base:
        before = by.get(out[-1].base)
        if before is None or before.sequence >= out[-1].sequence:
            return None
        out.append(before)
    return out[::-1]


def _adding(links: list[Head]) -> list[int]:
    return [h.sequence for h in links if h.added]


def _entries(spark: SparkSession, folder: str, links: list[Head]) -> DataFrame | None:
    """What the manifests of a chain add, with their sequence; none if a part is lost."""
    paths = [f"{folder}/entries/sequence={s}" for s in _adding(links)]
    if not paths:
        return spark.createDataFrame([], f"{_ENTRY}, sequence long")
    rows = _read(spark, *paths, base=f"{folder}/entries")
    return None if rows is None else rows.withColumn("sequence", F.col("sequence").cast("long"))


def committed_results(spark: SparkSession, folder: str, links: list[Head]) -> DataFrame | None:
    """The results that the manifests of a chain name; null statistics where one is lost."""
    entries, results = _entries(spark, folder, links), _read(spark, f"{folder}/results")
    if entries is None:
        return None
    if results is None:
        return entries.select(*ENTRY, "sequence", F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("mean", "m2", "min", "max")])
    found = results.select(*ENTRY, "n", "mean", "m2", "min", "max").dropDuplicates(list(ENTRY))
    return entries.join(found, list(ENTRY), "left")


def is_valid(spark: SparkSession, folder: str, head: Head, n_blocks: int, known: list[Head] | None = None) -> bool:
    """Whether a manifest holds (see ``_holds``); files that are lost or can't be read as what they should be make it invalid, other errors raise."""
    try:
        return _holds(spark, folder, head, n_blocks, heads(spark, folder) if known is None else known)
    except AnalysisException as e:
        if e.getCondition() in _LOST:
            return False
        raise
    except Exception as e:
        if _UNREADABLE in str(e):
            return False
        raise


def _holds(spark: SparkSession, folder: str, head: Head, n_blocks: int, known: list[Head]) -> bool:
    """Whether a manifest holds, from its leaves up.

    Every manifest of its chain is there and adds the entries that were written; ids are
    unique and of the run; incarnations and leases are above zero and not above the
    manifest's, and the lease is its own where the incarnation is; each entry has its
    result, whose digest is right; and the stored tree is, node by node and bit by bit,
    what these results make of it.  A completed one has all blocks, and the root's
    statistics.
    """
    links = chain(known, head)
    if links is None or sum(h.added for h in links) != head.committed:
        return False
    if head.committed == 0:
        return head.status != COMPLETED
    rows = committed_results(spark, folder, links)
    if rows is None or _digests(rows) != {h.sequence: (h.added, h.digest) for h in links if h.added}:
        return False
    checked = codec.with_checksum(rows, "computed")
    c = F.col
    ranged = c("block_id").between(0, n_blocks - 1) & c("incarnation").between(1, head.incarnation) & c("lease_epoch").between(1, head.lease_epoch)
    own = (c("incarnation") < head.incarnation) | (c("lease_epoch") == head.lease_epoch)
    if checked.where(~c("checksum").eqNullSafe(c("computed")) | ~F.coalesce(ranged & own, F.lit(False))).limit(1).count():
        return False
    if checked.select("block_id").distinct().count() != head.committed:
        return False
    if tree.differing(spark, folder, _adding(links), rows.select("block_id", *tree.VALUES), n_blocks).limit(1).count():
        return False
    whole = tree.root(spark, folder, _adding(links), n_blocks)
    if head.status != COMPLETED:
        return True
    return head.committed == n_blocks and whole is not None and codec.aggregate_payload(*whole) == codec.aggregate_payload(head.n, head.mean, head.m2, head.min, head.max)


def heads(spark: SparkSession, folder: str) -> list[Head]:
    """All manifests, newest first: a row a manifest."""
    rows = _read(spark, f"{folder}/heads")
    names = [x.split()[0] for x in _HEAD.split(", ")]
    return [] if rows is None else [Head(*r) for r in rows.select(*names).orderBy(F.desc("sequence")).collect()]


def latest_valid(spark: SparkSession, folder: str, n_blocks: int) -> Head | None:
    """The newest manifest that is whole; older ones stand in for damaged ones."""
    known = heads(spark, folder)
    return next((h for h in known if is_valid(spark, folder, h, n_blocks, known)), None)


def _write_heads(spark: SparkSession, folder: str, made: list[Head]) -> None:
    """The rows that make manifests count, in one file, so all of them do or none."""
    spark.createDataFrame([tuple(asdict(h).values()) for h in made], _HEAD).coalesce(1).write.mode("append").parquet(f"{folder}/heads")


def _write_entries(spark: SparkSession, folder: str, added: DataFrame, tasks: int) -> None:
    """What manifests add, by their column sequence."""
    typed = [F.col(c).cast(t) for c, t in (x.split() for x in _ENTRY.split(", "))]
    written = added.select(*typed, F.col("sequence").cast("long")).repartition(tasks, "sequence").write.partitionBy("sequence")
    written.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/entries")  # without its head, what is there does not count


def _write_manifest(spark: SparkSession, folder: str, head: Head, added: DataFrame | None = None) -> Head:
    """Writes a manifest that adds entries, or none, to those of its base; the row that makes it count comes last."""
    n, digest = 0, ""
    if added is not None:
        own = added.withColumn("sequence", F.lit(head.sequence))
        _write_entries(spark, folder, own, 1)
        n, digest = _digests(own).get(head.sequence, (0, ""))
    head = replace(head, added=n, committed=head.committed + n, digest=digest)
    _write_heads(spark, folder, [head])
    return head


def _open(spark: SparkSession, spec: RunSpec, folder: str) -> None:
    """Write what the run is, or check that it is this one."""
    mine = (codec.run_id(spec).hex(), codec.spec_hash(spec).hex(), codec.layout_hash(spec).hex(), BUILD)
    have = _read(spark, f"{folder}/metadata")
    if have is None:
        row = (*mine, json.dumps(asdict(spec), sort_keys=True))
        spark.createDataFrame([row], "run_id string, run_hash string, layout_hash string, build string, spec string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/metadata")
    elif [tuple(r) for r in have.select("run_id", "run_hash", "layout_hash", "build").collect()] != [mine]:
        raise RunError("the folder holds another run")


def run_durable(spark: SparkSession, spec: RunSpec, folder: str, batch_blocks: int = 1024, max_batches: int | None = None) -> DataFrame:
    """Run, or go on with, a run; one row (status, blocks, recovered, computed, n, mean, m2, min, max).

    Each batch of ``batch_blocks`` neighbouring block ids is one manifest.
    ``max_batches`` stops early, as if the driver were lost.  A completed run computes
    nothing; a failed one raises.
    """
    n_blocks = 1 + (spec.scenarios - 1) // spec.block_size
    _open(spark, spec, folder)
    past = heads(spark, folder)
    last = next((h for h in past if is_valid(spark, folder, h, n_blocks, past)), None)
    summary = lambda h, recovered: spark.createDataFrame(
        [(h.status, n_blocks, recovered, h.committed - recovered, h.n, h.mean, h.m2, h.min, h.max)],
        "status string, blocks long, recovered long, computed long, n long, mean double, m2 double, min double, max double",
    )
    if last and last.status == FAILED:
        raise RunError(f"the run has failed: {last.reason}")
    if last and last.status == COMPLETED:
        return summary(last, n_blocks)
    recovered = last.committed if last else 0
    links = chain(past, last) if last else []
    sequence = max((h.sequence for h in past), default=0) + 1
    incarnation = max(last.incarnation + 1 if last else 1, sequence)
    # the fence: from here on results of earlier incarnations are stale
    fence = Head(codec.run_id(spec).hex(), sequence, last.sequence if last else 0, RUNNING, incarnation, (last.lease_epoch if last else 0) + 1, recovered)
    head = _write_manifest(spark, folder, fence)
    links.append(head)
    batch = F.expr(f"block_id div {batch_blocks}")
    known = _entries(spark, folder, links).select("block_id", "checksum")
    pending = blocks(spark, spec).join(known, "block_id", "left_anti")
    todo = sorted(r[0] for r in pending.select(batch.alias("b")).distinct().collect())[:max_batches]
    run = {"run_hash": codec.spec_hash(spec).hex(), "layout_hash": codec.layout_hash(spec).hex(), "build": BUILD, "incarnation": incarnation, "rng_version": codec.RNG, "stats_schema": codec.STATS}
    per = max(1, min(WAVE_BATCHES, WAVE // (batch_blocks * spec.block_size * spec.steps)))
    before = _adding(links)
    by_chunk, above = {}, set(before)  # sequences by chunk of their blocks, and with nodes above chunks
    for i in range(0, len(todo), per):
        wave = todo[i : i + per]
        sequences = {b: head.sequence + 1 + k for k, b in enumerate(wave)}
        low, high = wave[0] * batch_blocks, min(n_blocks, (wave[-1] + 1) * batch_blocks)
        accepted, bad = _computed(spark, spec, folder, run, head.lease_epoch, known.where(F.col("block_id").between(low, high - 1)), batch, sequences, (low, high))
        if bad:
            wave = [b for b in wave if b < bad["batch"]]
            accepted = accepted.where(F.col("batch") < bad["batch"])
        chunks = {b: range(b * batch_blocks >> tree.CHUNK, (min(n_blocks, (b + 1) * batch_blocks) - 1 >> tree.CHUNK) + 1) for b in wave}
        found, made = _digests(accepted), []
        if found:
            near = {s for c in range(low >> tree.CHUNK, (high - 1 >> tree.CHUNK) + 1) for s in by_chunk.get(c, ())}
            above |= tree.add_each(spark, folder, accepted, n_blocks, sorted({*before, *near}), sorted(above))
            _write_entries(spark, folder, accepted, min(len(wave), spark.sparkContext.defaultParallelism))
        for b in wave:
            n, digest = found.get(sequences[b], (0, ""))
            head = replace(head, sequence=sequences[b], base=head.sequence, added=n, committed=head.committed + n, digest=digest)
            made.append(head)
            for c in chunks[b] if n else ():
                by_chunk.setdefault(c, []).append(head.sequence)
        if bad:
            reason = f"block {bad['block_id']}: {bad['status']}"
            _write_heads(spark, folder, [*made, replace(head, sequence=head.sequence + 1, base=head.sequence, status=FAILED, added=0, digest="", reason=reason)])
            raise RunError(reason)
        _write_heads(spark, folder, made)
        links += made
    if head.committed == n_blocks:
        whole = tree.root(spark, folder, sorted(above) if tree.height(n_blocks) > tree.CHUNK else _adding(links), n_blocks)
        head = _write_manifest(spark, folder, replace(head, sequence=head.sequence + 1, base=head.sequence, status=COMPLETED, **dict(zip(tree.VALUES, whole, strict=True))))
    return summary(head, recovered)


def _computed(spark: SparkSession, spec: RunSpec, folder: str, run: dict, lease: int, known: DataFrame, batch: Column, sequences: dict[int, int], ids: tuple[int, int]) -> tuple[DataFrame, Row | None]:
    """Computes and stores the results of some batches (batch to sequence) without the blocks ``known``; gives those accepted, and the first that does harm."""
    places = F.broadcast(spark.createDataFrame(list(sequences.items()), "batch long, sequence long"))
    path, tasks = f"{folder}/results/computed_in={run['incarnation']}", min(len(sequences), spark.sparkContext.defaultParallelism)
    own = blocks(spark, spec, *ids).withColumn("lease_epoch", F.lit(lease)).withColumn("batch", batch).join(places.select("batch"), "batch", "left_semi").drop("batch")
    made = codec.with_checksum(block_stats(spark, spec, own.join(F.broadcast(known.select("block_id")), "block_id", "left_anti")))
    marked = made.join(own.select("block_id", "start_scenario", "end_scenario", "lease_epoch"), "block_id").select("*", *[F.lit(v).alias(k) for k, v in run.items()])
    written = marked.withColumn("batch", batch).repartition(tasks, "batch").write.partitionBy("batch").option("partitionOverwriteMode", "dynamic")
    written.mode("overwrite").parquet(path)
    stored = spark.read.schema(marked.schema).parquet(*[f"{path}/batch={b}" for b in sequences])
    judged = validate_results(stored, own, known, run, spec.antithetic).withColumn("batch", batch).join(places, "batch")
    bad = judged.where("status <> 'Accepted' and not benign").orderBy("block_id").limit(1).collect()
    return judged.where("status = 'Accepted'"), bad[0] if bad else None


def compact(spark: SparkSession, spec: RunSpec, folder: str) -> int:
    """Writes the entries and nodes of the newest valid manifest as those of one; gives its sequence.

    Nodes are laid out by level and position.  What the older manifests added stays,
    for those that still name it.
    """
    n_blocks = 1 + (spec.scenarios - 1) // spec.block_size
    known = heads(spark, folder)
    last = latest_valid(spark, folder, n_blocks)
    if last is None:
        raise RunError("there is nothing to compact")
    links, sequence = chain(known, last), max(h.sequence for h in known) + 1
    nodes = spark.read.schema(tree.NODE).parquet(*[f"{folder}/tree/sequence={s}" for s in _adding(links)]) if _adding(links) else spark.createDataFrame([], tree.NODE)
    nodes.repartitionByRange("level", "position").sortWithinPartitions("level", "position").write.mode("overwrite").parquet(f"{folder}/tree/sequence={sequence}")
    _write_manifest(spark, folder, replace(last, sequence=sequence, base=0, committed=0), _entries(spark, folder, links))
    return sequence
