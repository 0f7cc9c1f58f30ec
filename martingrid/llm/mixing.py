"""Mixing sources to target weights over fixed-length token blocks.

Documents of a source are laid end to end in a keyed order and cut into blocks of
``block_words`` words.  Output shards of ``shard_slots`` slots each draw their
source counts from a multinomial over the target shares; what the draws of a
source exceed its quota by goes, in order, to the sources that fell short, so the
totals meet the targets.  Slot j of a source reads block perm(j mod n) of that
source's pseudorandom permutation, hence every block is read floor or ceil of the
mean number of times.  Only (source, block) rows are shuffled for this, no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martingrid.llm.common import SPACES, cut, let, word_array

#: A source may be repeated so often at most.
MAX_REPEATS = 3.0
WEIGHT_CYCLE = (5.0, 2.0, 1.0)
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 15
#: Documents laid out by one task; sources are cut into so many buckets.
BUCKET_DOCS = 1_000
#: The driver holds one row per source and refuses more.
MAX_SOURCES = 100_000
SEED = 20240229


def weight_targets(sizes: list[float], weights: list[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the summed size by weight; a share over max_repeats times its size stops there and its excess is reshared by weight."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    target = [0.0] * len(sizes)
    while True:
        free = total - sum(max_repeats * s for s, c in zip(sizes, capped, strict=True) if c)
        mass = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        target = [max_repeats * s if c else (free * w / mass if mass else 0.0) for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > max_repeats * s for s, t, c in zip(sizes, target, capped, strict=True)]
        if not any(over):
            return target
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of 0..size-1, one per key: a Feistel network on the next even power of two, walked until inside."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = out[todo] >> b, out[todo] & m
            for r in range(4):
                f = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
            out[todo] = left << b | right
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What the driver knows: a row per source (bounded by MAX_SOURCES)."""

    names: list[str | None]
    sizes: list[int]
    docs: list[int]
    targets: list[float]
    blocks: list[int]
    quotas: list[int]

    def frame(self, spark) -> DataFrame:
        rows = [
            (i, n, s, float(t), b, max(1, -(-d // BUCKET_DOCS)))
            for i, (n, s, d, t, b) in enumerate(zip(self.names, self.sizes, self.docs, self.targets, self.blocks, strict=True))
        ]
        return spark.createDataFrame(rows, "source_id int, source string, source_size long, target double, blocks long, buckets int")


def plan(sized: DataFrame, block_words: int, weights: dict[str | None, float] | None = None) -> Plan:
    """Targets and block quotas from (source, size); without weights sources by code point, null last, weigh 5, 2, 1, repeating."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    w = [WEIGHT_CYCLE[i % 3] if weights is None else float(weights.get(r["source"], 0.0)) for i, r in enumerate(rows)]
    sizes = [int(r["size"]) for r in rows]
    targets = weight_targets(sizes, w)
    blocks = [-(-s // block_words) for s in sizes]
    quotas = [min(3 * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, targets, blocks, strict=True)]
    return Plan([r["source"] for r in rows], sizes, [int(r["n"]) for r in rows], targets, blocks, quotas)


def _spread(drawn: np.ndarray, quota: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, nth surplus slot of it, to, ...) runs: surplus slots of over-drawn sources, dealt in order to short ones."""
    surplus, short = np.maximum(drawn - quota, 0), np.maximum(quota - drawn, 0)
    runs, to, used = [], 0, 0
    for s in range(len(quota)):
        at, left = quota[s], surplus[s]
        while left:
            while to < len(quota) and short[to] == used:
                to, used = to + 1, 0
            if to == len(quota):
                break
            n = int(min(left, short[to] - used))
            runs.append((s, int(at), n, to, int(drawn[to] + used)))
            at, left, used = at + n, left - n, used + n
    return runs


def draw_slots(spark, p: Plan, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(source_id, block, shard) of every output slot."""
    quota = np.array(p.quotas, dtype=np.int64)
    total = int(quota.sum())
    kind = "shard long, source_id int, n long"
    if not total:
        return spark.createDataFrame([], "source_id int, block long, shard long")
    share = quota / total
    shards = -(-total // shard_slots)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                n = min(shard_slots, total - int(shard) * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(n, share)
                yield pd.DataFrame({"shard": int(shard), "source_id": np.flatnonzero(counts).astype(np.int32), "n": counts[counts > 0]})

    parts = max(1, min(int(shards), 4 * spark.sparkContext.defaultParallelism))
    counts = cut(spark.range(0, shards, 1, parts).mapInPandas(draw, kind))
    drawn = np.zeros(len(quota), dtype=np.int64)
    for r in counts.groupBy("source_id").agg(F.sum("n").alias("n")).collect():
        drawn[r["source_id"]] = r["n"]
    blocks, keys = np.array(p.blocks, dtype=np.int64), np.array([(i * 0x632BE59BD9B4E019 + seed) % 2**64 for i in range(len(quota))], dtype=np.uint64)
    moves: dict[int, list[tuple[int, int, int, int]]] = {}
    for frm, *run in _spread(drawn, quota):
        moves.setdefault(frm, []).append(tuple(run))
    before = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, s, n, start in f[["shard", "source_id", "n", "start"]].itertuples(index=False):
                for a in range(0, n, 1 << 16):
                    j = start + np.arange(a, min(n, a + (1 << 16)), dtype=np.int64)
                    to = np.full(len(j), s, dtype=np.int32)
                    for at, length, dest, first in moves.get(s, ()):
                        moved = (j >= at) & (j < at + length) & (to == s)
                        to[moved], j[moved] = dest, j[moved] - at + first
                    yield pd.DataFrame({"source_id": to, "block": permute(j % blocks[to], blocks[to], keys[to]), "shard": shard})

    return (
        counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .repartition(parts, "shard", "source_id")
        .mapInPandas(place, "source_id int, block long, shard long")
    )


def lay_out(sized: DataFrame, p: Plan, seed: int = SEED) -> DataFrame:
    """(doc_id, source_id, size, copy, start): the first word of each document in its source.

    Two levels: documents are put in order inside keyed buckets, then the buckets'
    totals are summed up per source, so no task holds a whole source.
    """
    sources = F.broadcast(p.frame(sized.sparkSession).select("source_id", F.col("source").alias("name"), "buckets"))
    mixed = F.xxhash64("doc_id", "size", "copy", F.lit(seed))
    s = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        *KEY, F.pmod(mixed, F.col("buckets")).cast("int").alias("bucket"), F.xxhash64(mixed, F.lit(1)).alias("place")
    )
    inside = Window.partitionBy("source_id", "bucket").orderBy("place", "doc_id", "size", "copy")
    placed = s.withColumn("low", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = s.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    base = totals.withColumn("base", F.sum("words").over(upto) - F.col("words")).drop("words")
    return placed.join(base.hint("merge"), ["source_id", "bucket"]).select(*KEY, (F.col("base") + F.col("low")).alias("start"))


#: What names a document row; copy numbers rows that repeat the others.
KEY = ("doc_id", "source_id", "size", "copy")


def _size(text):
    return F.size(word_array(text.cast("string"))).cast("long")


def _pieces(docs: DataFrame, block_words: int, weights, seed: int) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, the laid-out documents, and (KEY, a, b, times): words a to b of a document are read so often."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), _size(F.col("text")).alias("size"))
    sized = cut(
        rows.groupBy("doc_id", "source", "size").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("count")
    )
    p = plan(sized, block_words, weights)
    laid = lay_out(sized, p, seed)
    spans = laid.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")))
    )
    times = draw_slots(docs.sparkSession, p, seed=seed).groupBy("source_id", "block").agg(F.count("*").alias("times"))
    pieces = spans.join(times.hint("merge"), ["source_id", "block"]).select(
        *KEY,
        (F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start")).alias("a"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("start")).alias("b"),
        "times",
    )
    return p, laid, pieces


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: dict | None = None, seed: int = SEED) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) per document row.

    size is the number of words (null text: 0), target the words its source should
    give, taken those of the document that the mix reads, repeats counted: at most
    3 * size.  Null sources form one source.  Equal inputs and seeds give equal
    rows, whatever the partitioning.  An empty table gives an empty result; columns
    besides doc_id, text and source are ignored.
    """
    p, laid, pieces = _pieces(docs, block_words, weights, seed)
    words = laid.select(*KEY, F.lit(0).cast("long").alias("taken")).union(pieces.select(*KEY, F.expr("times * (b - a)")))
    sources = F.broadcast(p.frame(docs.sparkSession).select("source_id", "source_size", "target"))
    return words.groupBy(*KEY).agg(F.sum("taken").alias("taken")).join(sources, "source_id").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: dict | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each run of words that one pass reads.

    A document read whole in a pass is returned unchanged; of one read in part, each
    run of neighbouring blocks becomes a row with that part of the text, separators
    included, and its n_chars if there is that column.  A pass is one reading of a
    block: blocks read t times occur in passes 1 to t.  Texts without words go, for
    the mix takes nothing from them.
    """
    p, _, pieces = _pieces(docs, block_words, weights, seed)
    runs = pieces.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b", "times"))).alias("runs"))
    name = F.broadcast(p.frame(docs.sparkSession).select("source_id", F.col("source").alias("name")))
    runs = runs.join(name, "source_id").select(F.col("doc_id").alias("doc"), "name", F.col("size").alias("n"), "copy", "runs")
    again = runs.where("copy > 1").limit(1).count()
    names = [f"c{i}" for i in range(len(docs.columns))]  # names that can't clash
    of = lambda c: F.col(names[docs.columns.index(c)])
    texts = docs.toDF(*names).withColumn("words", _size(of("text"))).where("words > 0")
    same = Window.partitionBy(of("doc_id"), of("source"), "words").orderBy(of("text"))
    texts = texts.withColumn("nth", F.row_number().over(same) if again else F.lit(1))
    both = texts.join(
        runs,
        of("doc_id").cast("long").eqNullSafe(F.col("doc")) & of("source").cast("string").eqNullSafe(F.col("name")) & (F.col("words") == F.col("n")) & (F.col("nth") == F.col("copy")),
    )
    # per pass: blocks read so often, joined to runs of neighbouring blocks
    merged = F.expr(
        """flatten(transform(sequence(1, cast(array_max(transform(runs, r -> r.times)) as int)), t ->
             aggregate(filter(runs, r -> r.times >= t), cast(array() as array<struct<a:bigint,b:bigint>>),
               (acc, r) -> if(size(acc) > 0 and element_at(acc, -1).b = r.a,
                 concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', r.b))),
                 concat(acc, array(named_struct('a', r.a, 'b', r.b)))))))"""
    )
    text = of("text").cast("string")
    whole = lambda c: (c["a"] == 0) & (c["b"] == F.col("words"))
    tokens = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = lambda ts, c: F.btrim(F.array_join(F.slice(ts, (c["a"] + 1).cast("int"), (c["b"] - c["a"]).cast("int")), ""), F.lit(SPACES))
    # a text is split once, for all its parts; one that is only read whole is not split
    split = let(tokens, lambda ts: F.transform("cuts", lambda c: F.when(whole(c), text).otherwise(part(ts, c))))
    parts = F.when(F.forall("cuts", whole), F.transform("cuts", lambda c: text)).otherwise(split)
    out = both.withColumn("cuts", merged).withColumn("part", F.explode(parts))
    new = {"text": F.col("part")} | ({"n_chars": F.length("part").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, of(c)).alias(c) for c in docs.columns])
