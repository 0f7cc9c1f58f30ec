"""Whitening of embeddings by a compensated covariance.

Plan: vectors become rows of integers and each different one is kept once (a hash
aggregation that merges copies before the shuffle) → exact sums → one pass that adds
centred outer products in double-double → eigenvectors of the small matrix → one pass
over all rows that projects them.  A block's centred rows are cut into slices of 20
bits, so that products of two slices over 4,096 rows are sums of integers below 2^53:
the matrix product makes no error, whatever its order, and only adding up the results
needs care, which two-sums give.  Tasks hold matrices of the vectors' length, never the
vectors; rows of these matrices meet by row number, high and low parts apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import cut
from martingrid.llm.eigen import eigen

#: An entry c counts as the integer floor(SCALE * c).
SCALE = 256
#: How many components a row is projected on.
COMPONENTS = 4
#: Rows of one matrix product, and bits of a slice: 2 * SLICE_BITS + log2(BLOCK) is 52.
BLOCK, SLICE_BITS, SLICES = 4096, 20, 4
#: The largest double that is a long.
_MOST = 2.0**63 - 1024
#: Partial matrices of so many tasks meet in one place first.
_FAN = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, x: np.ndarray, y=0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) + (x + y) in double-double."""
    s, e = two_sum(high, x)
    t, f = two_sum(low, np.broadcast_to(y, np.shape(low)))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of the outer products of the rows high + low, (rows, dims) with at most BLOCK rows."""
    dims = high.shape[1]
    top = np.abs(high).max(0, initial=0)
    unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - SLICE_BITS)  # of the first slice, by dimension
    slices, scales = [], []
    for k in range(SLICES):
        part = np.rint(high / unit)
        slices.append(part)
        scales.append(unit)
        high, low = two_sum(high - part * unit, low)
        unit = unit * 2.0**-SLICE_BITS
    total, rest = np.zeros((dims, dims)), np.zeros((dims, dims))
    for depth in range(SLICES - 1, -1, -1):  # the small products first
        for a in range(depth + 1):
            b = depth - a
            product = slices[a].T @ slices[b]
            total, rest = add(total, rest, product * scales[a][:, None] * scales[b][None, :])
    return total, rest


def _integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows count, their lengths, their entries as integers one after the other)."""
    lists = vectors.cast(pa.list_(pa.float64()))
    lengths = pa.compute.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = lists.flatten()
    c = entries.to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(np.where(entries.is_null().to_numpy(zero_copy_only=False), np.nan, c)) if len(c) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = (lengths >= 0) & (np.bincount(row, weights=bad, minlength=len(lengths)) == 0)
    kept = good[row] if len(row) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * c[kept]), -_MOST, _MOST).astype(np.int64)
    return good, lengths[good], x


def _padded(lengths: np.ndarray, x: np.ndarray, dims: int) -> np.ndarray:
    if (lengths == dims).all():
        return x.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = x
    return out


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to (code, dims): bytes that are equal exactly for vectors equal but for zeros at their ends."""
    for b in batches:
        _, lengths, x = _integers(b.column("embedding"))
        ends = np.cumsum(lengths)
        codes = []
        for at, n in zip((ends - lengths).tolist(), lengths.tolist(), strict=True):
            v = x[at : at + n]
            full = np.flatnonzero(v)
            v = v[: full[-1] + 1] if len(full) else v[:0]
            size = next(s for s in (1, 2, 4, 8) if not len(v) or (v.max() < 1 << (8 * s - 1) and v.min() >= -(1 << (8 * s - 1))))
            codes.append(bytes([size]) + v.astype(f"<i{size}").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(lengths, pa.int32())], ["code", "dims"])


def _decoded(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """Blocks of integer rows."""
    for b in batches:
        codes = b.column("code").to_pylist()
        for at in range(0, len(codes), BLOCK):
            part = codes[at : at + BLOCK]
            out = np.zeros((len(part), dims), dtype=np.int64)
            for i, code in enumerate(part):
                v = np.frombuffer(code, f"<i{code[0]}", offset=1)
                out[i, : len(v)] = v
            yield out


def _sums(dims: int):
    """Exact sum of each dimension over a task's vectors, as (dim, count, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for x in _decoded(batches, dims):
            n += len(x)
            exact = np.abs(x.astype(np.float64)).max(initial=0) < 2.0**50
            total = [a + b for a, b in zip(total, (x.sum(0) if exact else x.astype(object).sum(0)).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pylist([{"dim": i, "n": n, "total": str(s)} for i, s in enumerate(total)], pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    return run


def _strips(dims: int, vectors: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int):
    """A task's sum of outer products, as rows (place, dim, high, low); ``vectors`` makes centred double-double rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, rest, seen = np.zeros((size, size)), np.zeros((size, size)), False
        for x in _decoded(batches, dims):
            total, rest = add(total, rest, *outer_sums(*vectors(x)))
            seen = True
        if seen:
            place = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"place": place, "dim": i, "high": total[i].tolist(), "low": rest[i].tolist()} for i in range(size)], _STRIP)

    return run


_STRIP = pa.schema([("place", pa.int32()), ("dim", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])
_STRIP_SQL = "place int, dim int, high array<double>, low array<double>"


def _merged(key: tuple, strips: pa.Table) -> pa.Table:
    """One row for the strips of one dimension: added in the order of their places, so that reruns agree."""
    strips = strips.sort_by("place")
    high = low = None
    for h, e in zip(strips["high"], strips["low"], strict=True):
        h, e = h.values.to_numpy(), e.values.to_numpy()
        high, low = (h, e) if high is None else add(high, low, h, e)
    dim, group = key[0].as_py(), key[1].as_py()
    return pa.Table.from_pylist([{"place": group, "dim": dim, "high": high.tolist(), "low": low.tolist()}], _STRIP)


def second_moments(fit: DataFrame, dims: int, n: int, vectors: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """(1 / n) times the sum of outer products over the vectors, rounded once from double-double.

    Strips of up to 64 tasks meet first, then what is left, so that no task reads those of all.
    """
    strips = fit.select("code").mapInArrow(_strips(dims, vectors, size), _STRIP_SQL)
    for group in (F.floor(F.col("place") / _FAN).cast("int"), F.lit(0)):
        strips = strips.groupBy("dim", group.alias("batch")).applyInArrow(_merged, _STRIP_SQL)
    out = np.zeros((size, size))
    for r in strips.collect():  # one row a dimension
        out[r.dim] = [float((Fraction(h) + Fraction(e)) / n) for h, e in zip(r.high, r.low, strict=True)]
    return (out + out.T) / 2


def _centre(means: list[Fraction]):
    """Rows of integers less the means, as double-double; exact but for the last bit of the low part."""
    high = np.array([float(m) for m in means])
    low = np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist(), strict=True)])

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, e = two_sum(x.astype(np.float64), -high)
        return two_sum(d, e - low)

    return run


class Whitening:
    """What the fit list says: counts, sums, the leading components and how white the result is."""

    def __init__(self, fit: DataFrame, components: int):
        sized = fit.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
        self.n, self.dims = sized.n, sized.dims or 0
        self.sums, self.vectors, self.values = [0] * self.dims, np.zeros((self.dims, 0)), np.zeros(0)
        self.trace = self.identity_error = 0.0
        if not self.dims:
            return
        per_dim = fit.select("code").mapInArrow(_sums(self.dims), "dim int, n long, total string")
        for r in per_dim.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect():
            self.sums[r.dim] = int(r.s)
        centre = _centre([Fraction(s, self.n) for s in self.sums])
        v = second_moments(fit, self.dims, self.n, centre, self.dims)
        values, vectors = eigen(v)
        self.trace, self.vectors, self.values = float(np.trace(v)), vectors[:, :components], values[:components]
        self.identity_error = self._error(fit)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for a component without variance."""
        high, low = _centre([Fraction(s, self.n) for s in self.sums])(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.real())

    def real(self) -> np.ndarray:
        """The components' variances; NaN where it is zero to double precision."""
        least = self.values.max(initial=0) * self.dims * np.finfo(np.float64).eps
        return np.where(self.values > least, self.values, np.nan)

    def _error(self, fit: DataFrame) -> float:
        use = np.flatnonzero(~np.isnan(self.real()))
        if not len(use):
            return 0.0
        dims, project = self.dims, self.project

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rest = np.zeros(len(use)), np.zeros(len(use))
            for x in _decoded(batches, dims):
                for row in project(x)[:, use]:
                    total, rest = add(total, rest, row)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(use)), pa.int32()), pa.array(total + rest)], ["dim", "total"])

        means = np.zeros(len(use))
        for r in fit.select("code").mapInArrow(totals, "dim int, total double").groupBy("dim").agg(F.sum("total").alias("s")).collect():
            means[r.dim] = r.s / self.n

        def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return two_sum(project(x)[:, use], -means)

        return float(np.abs(second_moments(fit, dims, self.n, centred, len(use)) - np.eye(len(use))).max())


def fit_list(vectors: DataFrame) -> DataFrame:
    """(code, dims): each different vector of integers once."""
    codes = vectors.where("embedding is not null").select(F.col("embedding").cast("array<double>")).mapInArrow(_codes, "code binary, dims int")
    return codes.groupBy("code").agg(F.max("dims").alias("dims"))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; None beyond a long."""
    most = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 2.0**62:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(s) if s < 1 << 63 else None for s in (d * d).sum(1)]


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _projected(w: Whitening):
    k, explained = w.vectors.shape[1], w.values / w.trace if w.trace > 0 else np.full(len(w.values), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, lengths, x = _integers(b.column("embedding"))
            ids, rows = b.column("vec_id").filter(pa.array(good)), _padded(lengths, x, w.dims)
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                m = len(part)
                columns = [
                    ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array(_deviations(part, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.project(part).ravel(), from_pandas=True), pa.array(np.tile(explained, m), from_pandas=True), pa.array(np.full(m * k, w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and leading component.

    ``vectors`` has vec_id and embedding, a list of numbers; other columns are ignored.
    Rows whose vector is null or holds a null or a value that is not finite are left
    out; repeated rows and ids each get their own result, a null vec_id stays null.
    Vectors count as of the longest one's length, zeros filling up; with fewer
    dimensions than components there are fewer components, and none (so no rows) for an
    empty table or empty vectors.  Entries beyond a long count as the nearest one that
    is a double.  ``whitened`` is null for a component without variance, ``explained``
    too if there is no variance at all (equal vectors); ``deviation`` is null where the
    exact number is beyond a long.  Components of equal variance are any basis of theirs.
    """
    fit = Whitening(cut(fit_list(vectors)), components)
    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(_projected(fit), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
