"""SimHash near-duplicates by Golay-code fuzzy hashing.

Plan: fingerprints (one Python pass over the texts) → distinct fingerprints → fuzzy
keys, about 64 a fingerprint → rows of shared keys, next to each other after one
shuffle.  A key of at most ``CROWD`` fingerprints is compared in full, in blocks, and
gives one link a member: to the least one it reaches inside the key.  Members of a
fuller key are dealt out again by finer keys over the bits that the first did not
read.  Members of finer keys that are still fuller meet in midpoints: two fingerprints
differ in at most 4 bits exactly if some word lies within 2 bits of both.  So the work
grows with the number of distinct fingerprints, whatever the groups, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martingrid.llm.common import cut
from martingrid.llm.components import components
from martingrid.llm.golay import fuzzy_keys, split_keys, within_two

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Keys of up to so many fingerprints are compared in full.
CROWD = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set where over half of the shingles' hashes set it."""
    # bytes.split() parts at exactly the six separators of words
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist() if len(words) > shingle else [len(line)]
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for a in range(0, n, 8192):
        ones += np.unpackbits(octets[a : a + 8192], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column text becomes fp; the others stay."""
    for b in batches:
        found = np.fromiter((text_fingerprint(t) for t in map(pa.StringScalar.as_py, b.column("text"))), np.uint64, b.num_rows)
        at = b.schema.get_field_index("text")
        yield b.set_column(at, "fp", pa.array(found.view(np.int64)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; null and blank texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _keyed(rows: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """(key, fp, rep) of each row and each key that ``make`` gives, as (rows, keys), for 4,096 rows."""
    for b in rows:
        held = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        for a in range(0, b.num_rows, 4096):
            part = [x[a : a + 4096] for x in held]
            at, keys = make(*part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[0][at]), pa.array(part[1][at])], ["key", "fp", "rep"])


def _first_keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keyed(rows, lambda fp, rep: fuzzy_keys(fp.view(np.uint64)))


def _finer_keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keyed(rows, lambda fp, rep, key: (np.tile(np.arange(len(fp)), 5), split_keys(fp.view(np.uint64), key).ravel()))


def _midpoints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = within_two()
    for b in rows:
        fp, rep = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
        for a in range(0, len(fp), 64):
            near = fp[a : a + 64].view(np.uint64)[:, None] ^ masks
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().view(np.int64)), pa.array(np.repeat(rep[a : a + 64], len(masks)))], ["mid", "rep"])


def least_reached(fp: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For (groups, members): the least rep that each member reaches over close members of its group."""
    close = np.bitwise_count(fp[:, :, None] ^ fp[:, None, :]) <= DISTANCE
    while True:
        low = np.where(close, rep[:, None, :], np.iinfo(np.int64).max).min(2)
        if (low == rep).all():
            return low
        rep = low


_PARTS = pa.schema([(c, pa.int64()) for c in ("u", "v", "fp", "key")])


def _compare(crowd: int):
    """Rows (key, fp, rep, n), those of a key together, to links (u, v) inside keys; of fuller keys the rows themselves, v null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None  # the start of a key that goes on in the next batch
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep", "n")]
            full = new[3] > crowd
            if full.any():
                key, fp, rep, _ = (pa.array(x[full]) for x in new)
                yield pa.RecordBatch.from_arrays([rep, pa.nulls(len(rep), pa.int64()), fp, key], schema=_PARTS)
            new = [x[~full] for x in new]
            key, fp, rep, n = new if left is None else [np.concatenate(x) for x in zip(left, new, strict=True)]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            if size[-1] < n[-1]:
                left = [x[first[-1] :] for x in (key, fp, rep, n)]
                first, size = first[:-1], size[:-1]
            else:
                left = None
            for s in np.unique(size):
                starts, step = first[size == s], max(1, (1 << 20) // int(s * s))
                for a in range(0, len(starts), step):
                    at = starts[a : a + step, None] + np.arange(s)
                    low = least_reached(fp[at].view(np.uint64), rep[at])
                    u, v = rep[at][low < rep[at]], low[low < rep[at]]
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64())], schema=_PARTS)

    return run


def _inside_keys(keyed: DataFrame, crowd: int) -> DataFrame:
    """Links inside the keys that two or more fingerprints share, and the rows of keys with over ``crowd`` of them."""
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").sortWithinPartitions("key")
    return cut(shared.mapInArrow(_compare(crowd), "u long, v long, fp long, key long"))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(rep, component) of distinct fingerprints that link to another one.

    ``prints`` has one row (fp, rep) per distinct fingerprint; fingerprints of one rep
    count as linked.
    """
    found = _inside_keys(prints.select("fp", "rep").mapInArrow(_first_keys, _KEYED), crowd)
    edges = [found]
    full = found.where("v is null").select("fp", F.col("u").alias("rep"), "key")
    if full.limit(1).count():
        finer = _inside_keys(full.mapInArrow(_finer_keys, _KEYED), crowd)
        edges.append(finer)
        rest = finer.where("v is null").select("fp", F.col("u").alias("rep")).distinct()
        low = F.min("rep").over(Window.partitionBy("mid"))
        edges.append(rest.mapInArrow(_midpoints, "mid long, rep long").select(F.col("rep").alias("u"), low.alias("v")).where("u > v"))
    every = reduce(DataFrame.union, [e.where("v is not null").select("u", "v") for e in edges])
    return components(every).select(F.col("node").alias("rep"), "component")


_KEYED = "key long, fp long, rep long"


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row (doc_id, fp, component_id) per document row.

    component_id is the smallest doc_id reachable over links of at most 4 differing
    bits, the document itself included.  Null texts count as empty; all texts without
    words have fingerprint 0 and link like any other.  Repeated rows are returned as
    often as they occur; two texts that both have one id as the least of their copies
    count as linked.  Rows with a null doc_id name no component of their own: they
    get that of their fingerprint, or null.  An empty table gives an empty result;
    columns besides doc_id and text are ignored.
    """
    return _joined(cut(fingerprints(docs)), crowd)


def _joined(each: DataFrame, crowd: int) -> DataFrame:
    """The columns of ``each`` (doc_id, fp, ...) and component_id."""
    prints = each.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    linked = links(prints.where("rep is not null"), crowd)
    named = prints.join(linked, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return each.join(named, "fp", "left").select(*each.columns, "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    It is that of the smallest doc_id; of several rows with this id, that whose row
    hash over all columns is least, and of equal rows one.  Rows with a null doc_id
    can't be named and stay.  An empty table stays empty.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.alias("tag"))
    each = cut(tagged.mapInArrow(_fingerprints, "doc_id long, fp long, tag long"))
    least = _joined(each, crowd).where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "tag")).alias("r"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # names that can't clash
    marked = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index("doc_id")]).cast("long")).withColumn("tag", F.xxhash64(*names))
    kept = marked.join(least.select(F.col("r.doc_id").alias("id"), F.col("r.tag").alias("tag")), ["id", "tag"], "left_semi")
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("id", "tag").orderBy("id"))).where("nth = 1")
    return one.select(*names).union(marked.where("id is null").select(*names)).toDF(*docs.columns)
