"""The perfect binary Golay code as a source of fuzzy keys for 64-bit fingerprints.

Every 23-bit word lies within distance 3 of exactly one codeword.  ``near`` gives
the 12-bit indices of all codewords within distance 4: one for words within
distance 2 of their codeword, six for the others (5.3 on average).  Two words at
distance 2 or less always share one of them: a word between the two is within
3 of its own codeword, so both are within 4 of that codeword.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial and length of the Golay code.
GENERATOR = 0xC75
BITS = 23


def _remainder(w: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if w >> i & 1:
            w ^= GENERATOR << (i - 11)
    return w


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each high 12 bits, error patterns by syndrome padded to 6, how many there are)."""
    high = np.array([_remainder(h << 11) for h in range(1 << 12)], dtype=np.uint32)
    one = [_remainder(1 << i) for i in range(BITS)]
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            s = e = 0
            for i in at:
                s ^= one[i]
                e |= 1 << i
            found[s].append(e)
    errors = np.zeros((1 << 11, 6), dtype=np.uint32)
    for s, es in enumerate(found):
        errors[s] = (es + es[:1] * 6)[:6]
    return high, errors, np.array([len(x) for x in found], dtype=np.int64)


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (n, 6) codeword indices, and how many of each row count."""
    high, errors, count = tables()
    w = words.astype(np.uint32)
    s = (w & np.uint32(0x7FF)) ^ high[w >> np.uint32(11)]
    return ((w[:, None] ^ errors[s]) >> np.uint32(11)).astype(np.uint64), count[s]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for uint64 fingerprints: any two within 4 bits share a key.

    Four blocks of 16 bits hold at most 4 errors.  Either one block has none, and
    then of two 23-bit segments of the other 48 bits one has at most 2: keys are
    the block with the codeword indices near a segment (families 0 to 7).  Or each
    block has exactly one error: then one half of block 0 and one half of block 1
    are exact, and the 23 bits from block 2 on hold at most 2 (families 8 to 11).
    """
    fp = fp.astype(np.uint64)
    u = lambda x: np.uint64(x)
    block = [(fp >> u(16 * i)) & u(0xFFFF) for i in range(4)]
    parts = []
    for i in range(4):
        a, b, c = (block[j] for j in range(4) if j != i)
        rest = a | b << u(16) | c << u(32)
        for k in range(2):
            parts.append((block[i], rest >> u(23 * k) & u(0x7FFFFF)))
    tail = (block[2] | block[3] << u(16)) & u(0x7FFFFF)
    for left in (0, 8):
        for right in (0, 8):
            parts.append(((block[0] >> u(left) & u(0xFF)) << u(8) | block[1] >> u(right) & u(0xFF), tail))
    rows, keys = [], []
    at = np.arange(len(fp))
    for family, (exact, segment) in enumerate(parts):
        index, count = near(segment)
        use = np.arange(6)[None, :] < count[:, None]
        key = u(family << 28) | exact[:, None] << u(12) | index
        rows.append(np.repeat(at, count))
        keys.append(key[use])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def unread(family: int) -> list[int]:
    """The 25 bits of a fingerprint that a key of this family does not depend on."""
    if family < 8:
        i, k = divmod(family, 2)
        rest = [b for b in range(64) if b // 16 != i]
        return rest[: 23 * k] + rest[23 * k + 23 :]
    left, right = divmod(family - 8, 2)
    return [b for b in range(16) if b // 8 != left] + [16 + b for b in range(16) if b // 8 != right] + list(range(55, 64))


def split_keys(fp: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(5, n) finer keys for members of a key: two that share it and lie within 4 bits share one of them.

    The 25 bits that the key does not depend on are read as five pieces of five, of
    which four errors leave one exact.
    """
    fp, key = fp.astype(np.uint64), key.astype(np.uint64)
    out = np.zeros((5, len(fp)), dtype=np.uint64)
    for family in range(12):
        own = np.flatnonzero(key >> np.uint64(28) == family)
        for piece in range(5):
            for at, bit in enumerate(unread(family)[5 * piece : 5 * piece + 5]):
                out[piece, own] |= (fp[own] >> np.uint64(bit) & np.uint64(1)) << np.uint64(at)
    return ((np.arange(5, dtype=np.uint64)[:, None] << np.uint64(5) | out) << np.uint64(32) | key).astype(np.int64)


@lru_cache(maxsize=1)
def within_two() -> np.ndarray:
    """The 2,081 error patterns of at most two bits."""
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], dtype=np.uint64)
