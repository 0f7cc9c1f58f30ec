"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary files up to this size are broadcast to the tasks.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of pre-tokens and ids that a worker remembers, in each of two generations, and the longest pre-token it does so for.
REMEMBERED, LONGEST = 64 << 20, 256
#: Texts of up to so many code points are split at once, longer ones so many matches at a time.
SPLIT_AT_ONCE, MATCHES = 1 << 20, 1 << 16
#: Code points of texts that a worker reads before it hands on their results.
HANDED_ON = 4 << 20
#: Tokens decoded at a time.
DECODED_AT_ONCE = 1 << 18
_HASH = xxhash.xxh3_64_intdigest


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to 0..n-1; a bucket's shift is the seed of its keys' second hash."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = n // 3 + 1
        groups: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            groups.setdefault(_HASH(k) % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        free = bytearray(b"\1" * n)
        slots = self.slot_of = [0] * len(keys)
        singles = []
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = 1
            while True:
                at = {_HASH(keys[i], d) % n for i in members}
                if len(at) == len(members) and all(free[s] for s in at):
                    break
                d += 1
            self.shift[b] = d
            for i in members:
                slots[i] = _HASH(keys[i], d) % n
                free[slots[i]] = 0
        open_slots = (i for i in range(n) if free[i])
        for (b, i), s in zip(singles, open_slots, strict=False):
            slots[i] = s
            self.shift[b] = -s - 1  # a bucket of one names its slot


@lru_cache(maxsize=4)
def builtin_pattern(pattern: str) -> str | None:
    r"""The same pattern for the faster standard ``re``, good for texts without code points above U+FFFF.

    \p{L}, \p{N}, \s and \S become ranges that the ``regex`` module itself gives;
    a pattern with other escapes, flags or groups has no such form (None).
    """
    plane = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]

    def ranges(cls: str) -> str:
        hits = np.array([ord(c) for c in regex.findall(cls, "".join(plane))])
        runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
        return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)

    known = {c: ranges(c) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for m in re.finditer(r"\\p\{[LN]\}|\\.|\(\?.|.", pattern, re.S):
        t = m.group()
        if t in known:
            t = known[t] if inside else f"[{known[t]}]"
        elif t == r"\S" and not inside:
            t = f"[^{known[chr(92) + 's']}]"
        elif t[0] == "\\" or t[:2] == "(?" and t not in ("(?!", "(?=", "(?:"):
            return None
        elif t in "[]":
            inside = t == "["
        out.append(t)
    return "".join(out)


class Codec:
    """Ids of a text as tiktoken's encode_ordinary gives them, by two tiers.

    Built once on the driver and broadcast; what a worker remembers is not sent.  The
    perfect hash is the only table from bytes to ids: both tiers read it.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        pairs = [line.split() for line in vocabulary.splitlines() if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.hash = PerfectHash(list(ranks))
        keys, ids = [b""] * self.hash.n, np.zeros(self.hash.n, dtype=np.uint32)
        for (k, r), s in zip(ranks.items(), self.hash.slot_of, strict=True):
            keys[s], ids[s] = k, r
        self.hash.slot_of = []
        self.__setstate__((keys, ids, self.hash, pattern, builtin_pattern(pattern)))

    def __getstate__(self):
        return self.keys, np.array(self.ids, dtype=np.uint32), self.hash, self.pattern, self.plain

    def __setstate__(self, state):
        self.keys, ids, self.hash, self.pattern, self.plain = state
        self.ids = ids.tolist()
        self.find = regex.compile(self.pattern)
        self.find_plain = re.compile(self.plain) if self.plain else self.find
        # the same bytes once more, in order of ids, for decoding
        order = np.argsort(ids, kind="stable")
        size = np.fromiter(map(len, self.keys), np.int64, len(self.keys))[order]
        self.length = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
        self.length[ids[order]] = size
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join([self.keys[i] for i in order]), dtype=np.uint8)
        self.shift, self.buckets, self.n = self.hash.shift, self.hash.buckets, self.hash.n
        # what the table has for single bytes and pairs of bytes, which every merge begins with
        self.byte_ids = [self.rank(bytes([i])) for i in range(256)]
        self.pair_ranks = [self.rank(i.to_bytes(2, "big")) for i in range(1 << 16)]
        self.memo = _Memo(self)

    def rank(self, piece: bytes) -> int | None:
        """The id of a token, None for other bytes; ids are the order of merging too."""
        d = self.shift[_HASH(piece) % self.buckets]
        slot = -d - 1 if d < 0 else _HASH(piece, d) % self.n
        return self.ids[slot] if self.keys[slot] == piece else None

    def piece_ids(self, piece: bytes) -> bytes:
        whole = self.rank(piece)
        return self.merge(piece) if whole is None else whole.to_bytes(4, "little")

    def merge(self, piece: bytes) -> bytes:
        """Lowest rank first, leftmost among equals; n log n for a piece of n bytes."""
        n, rank = len(piece), self.rank
        end = list(range(1, n + 1))  # the part at i ends before end[i]
        before = list(range(-1, n))
        part = [self.byte_ids[b] for b in piece]  # id of the part at i
        pair = [self.pair_ranks[a << 8 | b] for a, b in pairwise(piece)]  # rank of the part at i with the next; None: no token
        pair.append(None)
        heap = [r * n + i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:  # merged since: the bytes from i on have grown, so the rank is another
                continue
            j = end[i]
            stop = end[i] = end[j]
            part[i] = r
            pair[j] = pair[i] = None
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    pair[i] = r
                    heappush(heap, r * n + i)
            if (p := before[i]) >= 0:
                pair[p] = r = rank(piece[p:stop])
                if r is not None:
                    heappush(heap, r * n + p)
        ids, i = [], 0
        while i < n:
            if part[i] is None:
                raise ValueError(f"the vocabulary lacks the byte {piece[i]}")
            ids.append(part[i])
            i = end[i]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        find, memo = self.find if _HIGH(text) else self.find_plain, self.memo.__getitem__
        if len(text) <= SPLIT_AT_ONCE:
            return b"".join(map(memo, find.findall(text)))
        out, matches = bytearray(), find.finditer(text)
        while part := b"".join([memo(m[0]) for m in islice(matches, MATCHES)]):
            out += part
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        """Gathers the bytes of all tokens at once, some DECODED_AT_ONCE tokens at a time."""
        tokens, out = np.frombuffer(ids, "<u4"), []
        for a in range(0, len(tokens), DECODED_AT_ONCE):
            t = tokens[a : a + DECODED_AT_ONCE]
            n = self.length[t]
            stop = np.cumsum(n)
            out.append(self.blob[np.repeat(self.start[t] - stop + n, n) + np.arange(stop[-1])].tobytes())
        return b"".join(out)


_HIGH = re.compile("[\U00010000-\U0010ffff]").search


class _Memo(dict):
    """Answers of both tiers for pre-tokens seen lately; the older generation goes when the newer is full."""

    def __init__(self, codec: Codec):
        self.codec, self.older, self.room = codec, {}, REMEMBERED

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.codec.piece_ids(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST:
            self.room -= 240 + 4 * len(piece) + len(ids)  # with what Python takes for an entry
            if self.room < 0:
                self.older, self.room = dict(self), REMEMBERED
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _broadcast(df: DataFrame, path: str, pattern: str):
    """The codec, whose size is that of the vocabulary."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary is over {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(codec(data, pattern))


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch, HANDED_ON code points at a time."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(map(pa.StringScalar.as_py, b.column("text"))):
        texts.append(t or "")
        size += len(texts[-1])
        if size > HANDED_ON:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


_ENCODED = "doc_id long, n_tokens long, ids binary, ids_sha256 string"


def encode(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256): ids is binary, little-endian unsigned 32-bit integers.

    Null and empty texts have no ids.  One row per row; other columns are ignored;
    an empty table gives an empty result.  Very long pre-tokens take n log n time.
    """
    return _code(docs, vocabulary_path, pattern, False)


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """``encode`` with decoded_sha256, the digest of the bytes that the ids decode to.

    Both ways in one pass of one worker, so that it holds the vocabulary once.
    """
    return _code(docs, vocabulary_path, pattern, True)


def _code(docs: DataFrame, vocabulary_path: str, pattern: str, back: bool) -> DataFrame:
    shared = _broadcast(docs, vocabulary_path, pattern)
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for at, texts in _slices(b):
                ids = [c.encode(t) for t in texts]
                out = {"doc_id": b.column("doc_id").slice(at, len(ids)), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "ids_sha256": pa.array(map(digest, ids), pa.string())}
                if back:
                    out["decoded_sha256"] = pa.array([digest(c.decode(x)) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ENCODED + ", decoded_sha256 string" * back)


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """``encoded`` with the column decoded (binary); null ids decode to nothing; a column of that name is replaced."""
    shared = _broadcast(encoded, vocabulary_path, pattern)
    rest = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            out = [c.decode(x or b"") for x in map(pa.BinaryScalar.as_py, b.column("ids"))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(out, pa.binary())], [*rest, "decoded"])

    schema = encoded.select(rest).schema.add("decoded", "binary")
    return encoded.select(rest).mapInArrow(run, schema)
