"""The median slope over all pairs of points, without forming the pairs.

The pairs whose slope is below t are the inversions of y - t x in the order of x, and
inversions can be counted by sorting.  Counts at a few pivots narrow the bracket that
holds the median until few enough slopes are left in it, and only those are listed.

Counting is spread over two cuts of the points, into ranges of x and into ranges of
y - t x: pairs apart in both follow from a table of counts by cell, pairs within a
range are counted by merging in a task of its own.  Comparisons of y - t x are exact:
the value is kept as three doubles that add up to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martingrid.operators import ranks
from martingrid.operators.scan import RANGES, with_range
from martingrid.sources.shared import kept

#: Ranges of y - t x.
ACROSS = 256
#: So many slopes may be listed whatever the number of points, and so many for each point.
LISTED, LISTED_EACH = 1 << 22, 4
#: Blocks of x whose pairs list their slopes, and candidates that a task holds at a time.
BLOCKS, HELD = 16, 1 << 22
#: Points whose slopes suggest pivots; they change the number of rounds only.
SUGGESTING = 1000
_ROUNDS = 100


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def residual(x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y - t x, exactly, as three doubles of falling size (barring underflow and overflow)."""
    split = lambda v: (h := v * 134217729.0 - (v * 134217729.0 - v), v - h)  # noqa: E731  Dekker's halves
    (xh, xl), (th, tl) = split(x), split(np.float64(t))
    p = x * t
    e = ((xh * th - p) + xh * tl + xl * th) + xl * tl
    s, f = _sum(y, -p)
    g, h = _sum(f, -e)
    a, g = _sum(s, g)
    b, c = _sum(g, h)
    a, b = _sum(a, b)
    b, c = _sum(b, c)
    return a, b, c


def inversions(order: np.ndarray) -> int:
    """Pairs of a permutation whose larger number comes first, by merging from the bottom up."""
    n = len(order)
    if n < 2:
        return 0
    size = 1 << (n - 1).bit_length()
    a, total, width = np.concatenate([order, np.arange(n, size)]), 0, 1
    while width < size:
        pairs = a.reshape(-1, 2 * width)
        merged = np.argsort(pairs, axis=1, kind="stable")
        right = np.flatnonzero(merged.ravel() >= width)
        # where a right-hand number ends up, less its own place, is how many left-hand ones are smaller
        total += len(pairs) * width * width - int((right % (2 * width)).sum()) + len(pairs) * width * (width - 1) // 2
        a = np.take_along_axis(pairs, merged, axis=1).ravel()
        width *= 2
    return total


def _falling(x: np.ndarray, y: np.ndarray, t: float, across: np.ndarray | None = None) -> int:
    """Pairs with x rising and y - t x falling; with ``across``, its ranges of y - t x, only pairs within one of them.

    Ordered by range first, pairs of different ranges never fall, for their y - t x rise with the range.
    """
    z = residual(x, y, t)
    first = np.lexsort((*z[::-1], x) if across is None else (*z[::-1], x, across))
    places = np.empty(len(x), dtype=np.int64)
    places[np.lexsort((np.arange(len(x)), *[v[first] for v in z[::-1]]))] = np.arange(len(x))
    return inversions(places)


def _counts(points: DataFrame, pivots: list[float]) -> list[int]:
    """For each pivot the number of slopes below it."""
    at = [i / ACROSS for i in range(1, ACROSS)]
    cuts = points.agg(*[F.percentile_approx(F.col("y") - F.col("x") * F.lit(t), at, 8 * ACROSS).alias(f"c{i}") for i, t in enumerate(pivots)]).first()
    cuts = [np.array(c) for c in cuts]

    def placed(batches):
        for b in batches:
            x, y, a = (b.column(c).to_numpy() for c in ("x", "y", "_range"))
            for p, t in enumerate(pivots):
                across = np.searchsorted(cuts[p], residual(x, y, t)[0], side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(a), pa.array(across), pa.array(x), pa.array(y)], ["p", "a", "b", "x", "y"])

    def within(key: tuple, rows: pa.Table, less_cells: bool) -> pa.Table:
        p, x, y = key[0].as_py(), rows["x"].to_numpy(), rows["y"].to_numpy()
        found = _falling(x, y, pivots[p])
        if less_cells:  # pairs of one cell are in a range of x and in one of y - t x: counted once
            found -= _falling(x, y, pivots[p], rows["b"].to_numpy())
        return pa.table({"p": pa.array([p], pa.int32()), "n": pa.array([found], pa.int64())})

    rows = points.select("x", "y", "_range").mapInArrow(placed, "p int, a int, b int, x double, y double")
    by_x = rows.groupBy("p", "a").applyInArrow(lambda k, r: within(k, r, True), "p int, n long")
    by_z = rows.groupBy("p", "b").applyInArrow(lambda k, r: within(k, r, False), "p int, n long")
    total = {r.p: int(r.n) for r in by_x.union(by_z).groupBy("p").agg(F.sum("n").alias("n")).collect()}
    cells = np.zeros((len(pivots), RANGES, ACROSS), dtype=np.int64)
    for p, a, b, n in rows.groupBy("p", "a", "b").count().collect():  # at most pivots x RANGES x ACROSS
        cells[p, a, b] = n
    out = []
    for p in range(len(pivots)):
        right = np.cumsum(cells[p][::-1], axis=0)[::-1]  # at least this range of x
        below = np.cumsum(right, axis=1)  # and at most this range of y - t x
        apart = (cells[p][:-1, 1:].astype(object) * below[1:, :-1]).sum()
        out.append(int(apart) + total.get(p, 0))
    return out


def _between(points: DataFrame, low: float, high: float) -> DataFrame:
    """(slope) of all pairs whose slope is at least ``low`` and below ``high``: blocks of x meet in pairs."""
    c = F.col
    block = (c("_range") / (RANGES // BLOCKS)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    dealt = points.select("x", "y", block.alias("own"), other.alias("o")).select("x", "y", "own", F.least("own", "o").alias("u"), F.greatest("own", "o").alias("v"))

    def listed(key: tuple, rows: pa.Table) -> pa.Table:
        u, v = (k.as_py() for k in key)
        x, y, own = (rows[n].to_numpy() for n in ("x", "y", "own"))
        left, right = np.flatnonzero(own == u), np.flatnonzero(own == v)
        out = [np.zeros(0)]
        if len(left) and len(right):
            z = residual(x, y, low)[0] if math.isfinite(low) else np.zeros(len(x))
            right = right[np.argsort(z[right], kind="stable")]
            slack = 2.0**-48 * (np.abs(y).max() + (abs(low) if math.isfinite(low) else 0) * np.abs(x).max())
            start, end = np.zeros(len(left), np.int64), np.full(len(left), len(right))
            if math.isfinite(low):
                start = np.searchsorted(z[right], z[left] - slack, side="left")
                if math.isfinite(high):
                    end = np.searchsorted(z[right], z[left] + (high - low) * np.maximum(x[right].max() - x[left], 0) + 2 * slack, side="right")
            upto = np.cumsum(np.maximum(end - start, 0))
            at = 0
            while at < len(left):
                done = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, done + HELD, side="right")))
                n = np.maximum(end[at:to] - start[at:to], 0)
                i = np.repeat(left[at:to], n)
                j = right[np.arange(n.sum()) + np.repeat(start[at:to] - (np.cumsum(n) - n), n)]
                good = x[i] < x[j]
                i, j = i[good], j[good]
                for t, below in ((low, False), (high, True)):
                    if math.isfinite(t):
                        d = _compare(residual(x[i], y[i], t), residual(x[j], y[j], t))
                        i, j = (i[d > 0], j[d > 0]) if below else (i[d <= 0], j[d <= 0])
                out.append((y[j] - y[i]) / (x[j] - x[i]))
                at = to
        return pa.table({"slope": np.concatenate(out)})

    return dealt.groupBy("u", "v").applyInArrow(listed, "slope double")


def _compare(a: tuple, b: tuple) -> np.ndarray:
    """Signs of a - b for numbers of three parts."""
    out = np.zeros(len(a[0]))
    for p, q in zip(a, b, strict=True):
        out = np.where(out == 0, np.sign(p - q), out)
    return out


def _suggested(sample: np.ndarray, low: float, high: float, f: float) -> list[float]:
    """Pivots within the bracket, where a share f of its slopes lies below the median's place."""
    inside = sample[(sample > low) & (sample < high)]
    out = []
    if len(inside):
        places = [f + d for d in (-0.2, -0.05, -0.01, -0.002, 0.002, 0.01, 0.05, 0.2)] if len(inside) > 1000 else [f]
        out += [float(np.quantile(inside, min(max(p, 0.0), 1.0), method="nearest")) for p in places]
        middle = float(np.quantile(inside, f, method="nearest"))
        out += [math.nextafter(middle, -math.inf), middle, math.nextafter(middle, math.inf)]
    if math.isfinite(low) and math.isfinite(high):
        out += [low + (high - low) * min(max(p, 0.0), 1.0) for p in (f - 0.02, f + 0.02, 0.5)]
    else:
        edge = low if math.isfinite(low) else high if math.isfinite(high) else 0.0
        far = max(abs(edge), 1.0)
        signs = [s for s, end in ((-1, low), (1, high)) if not math.isfinite(end)]
        out += [edge + s * far * k for s in signs for k in (1.0, 1e3, 1e9)]
    return sorted({t for t in out if low < t < high and math.isfinite(t)})


def median_slope(points: DataFrame, x: str, y: str, listed: int | None = None) -> tuple[int, float | None]:
    """(number of pairs, median slope) over all pairs of different ``x``; None without pairs.

    Rows with a null or a value that is not finite are left out; equal x make no pair.
    Of an even number of slopes the two in the middle are averaged.  ``listed`` bounds
    how many slopes may be formed (by default 2^22, or four a point); where more pairs
    than that share one slope, it is found as the only double of its bracket.
    """
    finite = lambda v: F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    clean = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite("x") & finite("y"))
    clean = kept(with_range(kept(clean), "x"))
    n = clean.count()
    same = clean.groupBy("x").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    pairs = n * (n - 1) // 2 - int(same or 0)
    if not pairs:
        return 0, None
    most = max(LISTED, LISTED_EACH * n) if listed is None else listed
    low, high, c_low, c_high = -math.inf, math.inf, 0, pairs
    wanted = ((pairs + 1) // 2, pairs // 2 + 1)
    sample = None
    for _ in range(_ROUNDS):
        if c_high - c_low <= most:
            rows = _between(clean, low, high).withColumn("all", F.lit(0))
            found = ranks.values_at(rows, ["all"], "slope", [lambda _, k=k: F.lit(k - c_low) for k in wanted]).first()
            return pairs, (found.v0 + found.v1) / 2 if found.v0 != found.v1 else found.v0
        if math.nextafter(low, math.inf) >= high:
            return pairs, low
        if sample is None:
            some = np.array(clean.select("x", "y").orderBy(F.xxhash64("x", "y")).limit(SUGGESTING).collect())
            i, j = np.triu_indices(len(some), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                sample = (some[j, 1] - some[i, 1]) / (some[j, 0] - some[i, 0])
            sample = sample[np.isfinite(sample)]
        pivots = _suggested(sample, low, high, (wanted[0] - c_low) / (c_high - c_low))
        for t, count in zip(pivots, _counts(clean, pivots), strict=True):
            if count < wanted[0] and t > low:
                low, c_low = t, count
            if count >= wanted[1] and t < high:
                high, c_high = t, count
    raise ArithmeticError("the bracket of the median slope did not narrow")
