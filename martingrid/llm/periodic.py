"""Runs (maximal repetitions) of words, by refining classes of positions.

Positions are in one class at level l if the l words from each on are equal.  Level 1
are the words; a class splits by the classes of the positions one further right, and
only the smaller parts of what last split have to be looked at (Crochemore, 1981), so
that a position moves at most log n times.  Members of a class are linked in rising
order.  A link of distance d that is there at level d is a square: d words twice in a
row, no shorter period.  Squares of one period at positions in a row are one run.

The texts of a block are refined together, each with an end of its own, so that a
level costs a few array operations for all of them.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least length of a run, beside twice its period.
MIN_LENGTH = 12
#: Texts are refined together up to about so many words; a longer text is a block of its own.
BLOCK_WORDS = 1 << 20


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _ordered(bits: int, *parts: np.ndarray) -> list[np.ndarray]:
    """The parts, each below 2^bits, ordered by the first, then the next."""
    if bits * len(parts) < 63:
        key = parts[0]
        for x in parts[1:]:
            key = key << bits | x
        key = np.sort(key)
        return [(key >> bits * k) & ((1 << bits) - 1) for k in range(len(parts) - 1, -1, -1)]
    order = np.lexsort(parts[::-1])
    return [x[order] for x in parts]


class _Classes:
    """Classes of positions, and the squares seen while they were refined."""

    def __init__(self, words: np.ndarray, bits: int):
        n = len(words)
        self.bits, self.level, self.n_classes = bits, 1, 0
        word, self.members = _ordered(bits, words, np.arange(n))
        first = np.concatenate(([True], word[1:] != word[:-1]))
        begin = np.flatnonzero(first)
        self.n_classes = len(begin)
        # of classes: their places in members; of positions: class, place, neighbours in the class, level since when the link to the right is there
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(begin)], self.size[: len(begin)] = begin, np.diff(np.append(begin, n))
        self.of, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.members], self.place[self.members] = np.cumsum(first) - 1, np.arange(n)
        self.right, self.left = np.full(n, -1), np.full(n, -1)
        self.since, self.moved = np.ones(n, np.int64), np.zeros(n, bool)
        self._link(self.members, ~first[1:])
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _link(self, at: np.ndarray, same: np.ndarray) -> None:
        """Positions in class order become neighbours where ``same`` says that the next is of their class."""
        self.right[at], self.left[at] = -1, -1
        self.right[at[:-1][same]], self.left[at[1:][same]] = at[1:][same], at[:-1][same]

    def _seen(self, at: np.ndarray, last: int | np.ndarray) -> None:
        """Notes the squares among links that end now, or at level ``last`` of their text."""
        d = self.right[at] - at
        good = (self.since[at] <= d) & (d <= last)
        if good.any():
            self.squares.append((at[good], d[good]))

    def refine(self, small: np.ndarray, bound: int) -> np.ndarray:
        """Goes from this level to the next, for positions below ``bound``; ``small`` are the members of small classes, as is the result."""
        before = small - 1
        before_of = self.of[before]
        use = (before >= 0) & (before < bound) & (self.size[before_of] > 1)
        cls, by, at = _ordered(self.bits, before_of[use], self.of[small[use]], before[use])
        self.level += 1
        if not len(at):
            return at
        cut = np.flatnonzero(np.concatenate(([True], (cls[1:] != cls[:-1]) | (by[1:] != by[:-1]))))
        count, parent = np.diff(np.append(cut, len(at))), cls[cut]
        head = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        split = parent[head]
        total, largest = np.add.reduceat(count, head), np.maximum.reduceat(count, head)
        rest = self.size[split] - total
        top = np.flatnonzero(count == np.repeat(largest, np.diff(np.append(head, len(parent)))))
        top = top[np.searchsorted(top, head)]  # the first largest part of each class
        leaves, is_small = np.ones(len(count), bool), np.ones(len(count), bool)
        leaves[top[rest == 0]] = False  # of a class whose members all have a part, one part stays
        is_small[top[rest < largest]] = False
        if not leaves.all():
            stay = np.repeat(leaves, count)
            at, count, parent, is_small = at[stay], count[leaves], parent[leaves], is_small[leaves]
            total = total - np.where(rest == 0, largest, 0)
            some = total > 0
            split, total, rest, largest = split[some], total[some], rest[some], largest[some]
            if not len(at):
                return at
        self._unlink(at, parent, count, len(split))
        new = np.arange(self.n_classes, self.n_classes + len(count))
        self.n_classes += len(count)
        owner = np.repeat(new, count)
        self._link(at, owner[1:] == owner[:-1])
        self.since[at] = self.level
        self._move(at, owner, split, total)
        begin = np.cumsum(count) - count
        self.start[new], self.size[new] = self.place[at[begin]], count
        self.size[split] -= total
        left = split[(rest > 0) & (rest < largest)]
        return np.concatenate([at[np.repeat(is_small, count)], self.members[_ranges(self.start[left], self.size[left])]])

    def _unlink(self, at: np.ndarray, parent: np.ndarray, count: np.ndarray, n_split: int) -> None:
        """Takes positions out of their classes' links."""
        if len(parent) > n_split:
            _, at = _ordered(self.bits, np.repeat(parent, count), at)
        before = self.left[at]
        head = np.flatnonzero(np.concatenate(([True], before[1:] != at[:-1])))
        a, b = before[head], self.right[at[np.append(head[1:], len(at)) - 1]]
        has_a, has_b = a >= 0, b >= 0
        self._seen(np.concatenate([at, a[has_a]]), self.level - 1)
        self.right[a[has_a]], self.left[b[has_b]] = b[has_a], a[has_b]
        self.since[a[has_a]] = self.level

    def _move(self, at: np.ndarray, owner: np.ndarray, split: np.ndarray, total: np.ndarray) -> None:
        """Moves positions to the ends of their classes' places, which their new classes take over."""
        low = self.start[split] + self.size[split] - total
        tail = _ranges(low, total)
        there = self.members[tail]
        self.moved[at] = True
        stays = there[~self.moved[there]]
        vacant = self.place[at]
        vacant = vacant[vacant < np.repeat(low, total)]
        self.members[vacant], self.place[stays] = stays, vacant
        self.members[tail], self.place[at] = at, tail
        self.of[at], self.moved[at] = owner, False


def runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each text, given as word numbers, its runs as rows (start, length, period), by start, then period.

    A run has at least ``min_length`` words and twice its smallest period.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))
    n = int(offset[-1])
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    if not n:
        return out
    words, used = np.empty(n, dtype=np.int64), 0
    for i, a in zip(order, offset.tolist(), strict=False):
        m = len(texts[i])
        words[a : a + m] = texts[i] + used
        used += int(texts[i].max(initial=-1)) + 1
        words[a + m] = used
        used += 1
    classes = _Classes(words, max(1, int(max(n, used)).bit_length()))
    half = sizes // 2
    small = np.arange(n)
    while len(small):
        bound = int(offset[np.searchsorted(-half, -(classes.level + 1), side="right")])  # texts with squares of this length
        if not bound:
            break
        small = classes.refine(small, bound)
    linked = np.flatnonzero(classes.right >= 0)
    classes._seen(linked, np.repeat(half, sizes + 1)[linked])
    if not classes.squares:
        return out
    at, period = (np.concatenate(x) for x in zip(*classes.squares, strict=True))
    keep = np.lexsort((at, period))
    at, period = at[keep], period[keep]
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1]))))
    length = at[np.append(head[1:], len(at)) - 1] - at[head] + 2 * period[head]
    head, length = head[length >= min_length], length[length >= min_length]
    keep = np.lexsort((period[head], at[head]))
    start, length, period = at[head][keep], length[keep], period[head][keep]
    text = np.searchsorted(offset, start, side="right") - 1
    found = np.stack([start - offset[text], length, period], axis=1)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    for k in np.unique(text).tolist():
        out[order[k]] = found[cuts[k] : cuts[k + 1]]
    return out


def repeated_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands where, in the texts that the contract makes periodic."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _report(rows: list[tuple[int | None, list[bytes], np.ndarray]]) -> pa.RecordBatch:
    out = []
    for (doc_id, words, numbers), found in zip(rows, runs([r[2] for r in rows]), strict=True):
        best = [None] * 4
        if len(found):
            start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
            best = [start, length, period, 1000 * length // period]
            words = itertools.compress(words, ~repeated_words(len(numbers), found))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
        out.append((doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)


def _scan(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                # bytes.split() parts at exactly the six separators of words
                words = (text.as_py() or b"").split()
                known: dict[bytes, int] = {}
                number = known.setdefault
                numbers = np.array([number(w, len(known)) for w in words], dtype=np.int64)
                if (source := _planted(doc_id, len(words))) is not None:
                    words, numbers = [words[i] for i in source.tolist()], numbers[source]
                rows.append((doc_id, words, numbers))
                held += len(words)
                if held >= block_words:
                    yield _report(rows)
                    rows, held = [], 0
        if rows:
            yield _report(rows)

    return run


def find_runs(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row.

    A row's result depends on its doc_id and text only, so repeated rows and ids get
    equal or own results; of runs of equal length the one of least start, then least
    period, is reported.  Null and blank texts have no words: no runs, the digest of
    nothing twice.  A null doc_id makes no periodic text.  Texts of any length are read
    whole, in memory that grows with the longest text (about 150 bytes a word) and time
    n log n.  An empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(_scan(block_words), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
