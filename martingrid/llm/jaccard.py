"""Jaccard join of n-gram sets by vertical partitioning.

The n-grams have one global order, that of their hashes, which is cut into fragments;
every set falls into the same fragments.  Plan:

1. Sets of at least 90 % overlap and like size differ in at most d n-grams, so of more
   than d fragments one at least holds the same n-grams in both.  Digests of a set's
   parts by fragment are its keys; sizes are cut into classes, each with its fragments.
2. Keys that two or more different sets have are candidates.  Every set gets 512 bits,
   one flipped by each n-gram: two sets differ in at least as many n-grams as these
   bits, so most candidates go without a look at their n-grams, and no pair is lost.
3. The n-grams of sets with candidates are made anew from the texts; a bit map of fixed
   size says for which documents (the rest is left to a join by set, so it may be full).
   Each key's sets are paired with its most typical one only.  Overlaps are counted by
   fragment, each (pair, fragment) on its own, and summed per pair.
4. Sets that are linked by now need not be paired; only sets of one key in different
   components are, and counted alike.

So a group of near copies costs pairs in proportion to its members, and none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import cut
from martingrid.llm.components import components

WORDS = 3
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Fragments beyond those that pigeonholes need: so many empty parts of a set are no keys.
SPARE = 2
SKETCH_LONGS = 8
#: Fragments in which overlaps are counted.
COUNTED = 8
#: Bits that say which documents' n-grams are wanted: 4 MB, whatever the corpus.
WANTED_BITS = 1 << 25
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits (multiply and shift)."""
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def ngrams(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The set of n-grams of words, A-Z lower-cased, as rising 64-bit hashes; fewer words are one n-gram, none no set."""
    # bytes.lower() changes A-Z alone, bytes.split() parts at exactly the six separators of words
    w = (text or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    if not len(w):
        return h
    n = min(words, len(w))
    x = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = _mix(x) + h[i : len(w) - n + 1 + i]
    return np.unique(_mix(x))


def most_different(x: int, y: int, percent: int = PERCENT) -> int:
    """How many n-grams sets of these sizes have in one of them only at most, if they link."""
    return (100 - percent) * (x + y) // (100 + percent)


@lru_cache(maxsize=4)
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(least sizes of classes, numbers of fragments for pairs whose smaller set is of the class).

    Of two sets that link, the larger one is of the smaller one's class or the next.
    Sets below the first class link with equal sets only.
    """
    least = [next(n for n in range(1, 10_000) if most_different(n, n + 1, percent))]
    while least[-1] < 1 << 31:
        least.append(-(-least[-1] * 100 // percent))
    top = [n - 1 for n in least[1:]]
    return np.array(least), np.array([most_different(n, n * 100 // percent, percent) + 1 + SPARE for n in top])


def _fragment(grams: np.ndarray, count: int) -> np.ndarray:
    return ((grams >> _U(32)) * _U(count) >> _U(32)).astype(np.int64)


def keys_of(grams: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Digests of the set's parts, for its own class and the one below."""
    least, counts = size_classes(percent)
    own, out = int(np.searchsorted(least, len(grams), side="right")) - 1, []
    for c in (own, own - 1):
        if c < 0:
            continue
        fragment = _fragment(grams, int(counts[c]))
        at = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
        part = np.add.reduceat(grams, at)
        place = fragment[at]
        empty = np.setdiff1d(np.arange(counts[c]), place, assume_unique=True)
        if len(empty) > SPARE:
            place, part = np.concatenate([place, empty]), np.concatenate([part, np.zeros(len(empty), np.uint64)])
        out.append(_mix(part + _mix(place.astype(np.uint64) + (_U(c) << _U(32)))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """Bits flipped once by each n-gram."""
    bits = np.bincount((grams & _U(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


_NAMES = ["doc_id", "sid", "n", "keys", *(f"s{i}" for i in range(SKETCH_LONGS))]


def _described(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [ngrams(t.as_py(), words) for t in part.column("text")]
                sketch = np.array([sketch_of(g) for g in sets])
                ids = np.array([xxhash.xxh3_64_intdigest(g.tobytes()) for g in sets], dtype=np.uint64).view(np.int64)
                columns = [part.column("doc_id"), pa.array(ids), pa.array([len(g) for g in sets], pa.int64()), _lists([keys_of(g, percent) for g in sets])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c) for c in sketch.T], _NAMES)

    return run


def _place(doc_id: str | Column = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(WANTED_BITS)).alias("place")


def wanted_bits(chosen: DataFrame) -> np.ndarray:
    """A bit for each doc_id, several ids may share one; gathered as at most 1,024 pieces of 4 KB."""
    piece = 1 << 15
    pieces = chosen.select(_place()).groupBy(F.floor(F.col("place") / piece).alias("at")).agg(F.bitmap_construct_agg(F.col("place") % piece).alias("bits"))
    out = np.zeros((WANTED_BITS // piece, piece // 8), dtype=np.uint8)
    for r in pieces.collect():
        out[r.at] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def _parts(words: int, wanted):
    """(sid, fragment, grams): the n-grams of documents whose bit is set, by the fragments in which they are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").to_numpy()
            for i in np.flatnonzero(wanted.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).tolist():
                g = ngrams(b.column("text")[i].as_py(), words)
                cuts = np.searchsorted(_fragment(g, COUNTED), np.arange(COUNTED + 1))
                sid = np.full(COUNTED, xxhash.xxh3_64_intdigest(g.tobytes()), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.arange(COUNTED, dtype=np.int32)), _lists([g[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])], ["sid", "fragment", "grams"])

    return run


def _may_link(a: str, b: str, percent: int) -> Column:
    """By sizes and by bits alone; true for every pair that links."""
    of = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    n, m = of("n")
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in map(of, _NAMES[4:])), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, common) for pairs (a, b) of sets: counted by fragment, then summed."""
    left = pairs.join(parts.withColumnsRenamed({"sid": "a", "grams": "of_a"}), "a")
    both = left.join(parts.withColumnsRenamed({"sid": "b", "grams": "of_b"}), ["b", "fragment"])
    partial = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return partial.groupBy("a", "b").agg(F.sum("common").alias("common"))


def _links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n, m), n and m being their sizes, that link, as (u, v)."""
    distinct = pairs.groupBy("a", "b").agg(F.max(F.col("n") + F.col("m")).alias("total"))
    found = overlaps(distinct.select("a", "b"), parts).join(distinct, ["a", "b"])
    return cut(found.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _pairs(rows: DataFrame) -> DataFrame:
    """Columns x.sid, x.n, y.sid, y.n as (a, b, n, m), a below b."""
    a, b = F.col("x.sid"), F.col("y.sid")
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per document row.

    component_id is the smallest doc_id reachable over links, the document itself
    included.  Null and blank texts have no set: they link with nothing, and their
    component is their doc_id.  Repeated rows are returned as often as they occur;
    rows of one id with different texts are told apart, and have the components of
    their texts.  A null doc_id names no component: such rows get the smallest id
    reachable, or null.  Texts are read whole; an empty table gives an empty result;
    columns besides doc_id and text are ignored.  N-grams and sets are told apart by
    64-bit hashes.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, at most 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sketch = ", ".join(f"{c} long" for c in _NAMES[4:])
    sets = cut(texts.mapInArrow(_described(words, percent), f"doc_id long, sid long, n long, keys array<long>, {sketch}"))

    keyed = sets.select(F.explode("keys").alias("key"), "sid").repartition("key")  # dealt once, read twice
    several = keyed.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("key")
    shared = cut(keyed.join(several, "key", "left_semi").distinct())

    typical = shared.groupBy("sid").agg(F.count("*").alias("n_keys"))
    known = sets.select("sid", "doc_id", *_NAMES[2:3], *_NAMES[4:]).join(typical, "sid")
    facts = known.groupBy("sid").agg(F.max("n_keys").alias("n_keys"), F.min("doc_id").alias("one"), *(F.max(c).alias(c) for c in ("n", *_NAMES[4:])))
    facts = cut(facts)
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_bits(facts.select(F.col("one").alias("doc_id"))))
    parts = texts.withColumn("place", _place()).mapInArrow(_parts(words, wanted), "sid long, fragment int, grams array<long>")
    parts = cut(parts.join(typical.select("sid"), "sid", "left_semi").dropDuplicates(["sid", "fragment"]))

    rows = shared.join(facts.drop("one"), "sid")
    first = F.max(F.struct("n_keys", "sid", "n", *_NAMES[4:])).alias("top")
    tops = rows.groupBy("key").agg(first).select("key", "top.*").drop("n_keys")
    to_top = rows.alias("x").join(tops.alias("y"), "key").where((F.col("x.sid") != F.col("y.sid")) & _may_link("x", "y", percent))
    links = _links(_pairs(to_top), parts, percent)

    label = components(links).select(F.col("node").alias("sid"), "component")
    rows = cut(rows.join(label, "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    apart = (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component"))
    across = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & _may_link("x", "y", percent))
    links = links.union(_links(_pairs(across), parts, percent))

    label = components(links).select(F.col("node").alias("sid"), "component")
    each = sets.select("doc_id", "sid", "n").join(label, "sid", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("component"))
    least = each.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return each.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
