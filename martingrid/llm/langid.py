"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows and broadcast (BUCKETS * DIM + languages * DIM floats).  ``score`` is a
calibrated confidence; predictions below a threshold learnt with it are ``rejected``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS, DIM = 1 << 14, 16
#: Character n-grams of a word, whose ends count as characters; a whole word is one more feature.
GRAMS = (1, 2, 3, 4)
#: At most so many labelled rows train the model, each by so many pieces spread over its whole text.
MAX_ROWS, MAX_PIECES = 4_000, 20
#: Short training pieces make the model good at short texts.
PIECE_WORDS = (2, 40)
EPOCHS, RATE, SEED = 6, 0.5, 7
#: A tenth of the pieces calibrates: the confidence, and the least one at which this share of the predictions above it is right.
CALIBRATION, PRECISION = 0.1, 0.99
#: Long texts are read in blocks of so many code points, cut between words.
BLOCK = 1 << 20
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _SPREAD
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature of a lower-case text: hashes over its code points, no loop over words.

    An n-gram may begin or end with one of a word's two ends but never spans words.
    """
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letters()[codes]
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1  # one past the word
    word = np.cumsum(np.concatenate(([False], letter[1:] & ~letter[:-1]))) - 1
    c = (np.where(letter, codes, 0) + 1).astype(np.uint64)
    buckets, words = [], []
    h, inner = np.zeros(len(c), dtype=np.uint64), np.ones(len(c), dtype=bool)
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * _STEP + c[n - 1 :]
        if n > 2:  # all but the two ends of a window are letters
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        ok = np.flatnonzero(inner if n > 2 else letter[:m] | letter[n - 1 :])
        buckets.append(_bucket(h[ok] + np.uint64(n)))
        words.append(word[ok + (~letter[ok]).astype(np.int64)])
    powers = np.cumprod(np.full(int((last - first).max()) + 1, _STEP))
    place = np.arange(len(c)) - first[np.maximum(word, 0)]
    terms = np.where(letter, c * powers[np.where(letter, place, 0)], np.uint64(0))
    buckets.append(_bucket(np.add.reduceat(terms, first)))
    words.append(np.arange(len(first)))
    return np.concatenate(buckets), np.concatenate(words)


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks of at most BLOCK code points, cut before a character that is no letter where there is one."""
    a = 0
    while len(text) - a > BLOCK:
        b = a + BLOCK
        while b > a and text[b].isalpha():
            b -= 1
        b = b if b > a else a + BLOCK
        yield text[a:b]
        a = b
    yield text[a:]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray
    weight: np.ndarray
    temperature: float = 1.0
    #: Predictions of a lower confidence are rejected.
    least: float = 0.0

    def mean(self, text: str) -> np.ndarray | None:
        """Mean embedding of all features of a text."""
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for part in _blocks(text.lower()):
            counts += np.bincount(_features(part)[0], minlength=BUCKETS)
        n = counts.sum()
        return counts.astype(self.embed.dtype) @ self.embed / n if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, rejected); of equally likely languages the first by code point."""
        h = self.mean(text or "")
        if h is None or not self.languages:
            return UNKNOWN, 0.0, True
        p = _softmax(h @ self.weight.T / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.least)


_WORDS = re.compile(r"[^\W\d_]+")


def pieces_of(text: str, rng: np.random.Generator) -> Iterator[str]:
    """Up to MAX_PIECES pieces of PIECE_WORDS words, evenly spread over the whole text."""
    reach = 20 * PIECE_WORDS[1]
    n = min(MAX_PIECES, max(1, len(text) // (reach // 4)))
    for k in range(n):
        a = k * len(text) // n
        part = text[a : a + reach].lower()
        words = _WORDS.findall(part)
        if a and words and part[0].isalpha() and text[a - 1].isalpha():
            words = words[1:]  # begins within a word
        if a + reach < len(text) and len(words) > 1 and part[-1].isalpha():
            words = words[:-1]
        if words:
            yield " ".join(words[: int(rng.integers(*PIECE_WORDS))])


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows; an empty list gives one that knows no language."""
    languages = sorted({y for _, y in rows})
    rng = np.random.default_rng(SEED)
    pieces: list[tuple[np.ndarray, np.ndarray, int]] = []  # buckets, their shares, language
    for text, y in rows:
        for piece in pieces_of(text, rng):
            buckets, _ = _features(piece)
            if len(buckets):
                ids, times = np.unique(buckets, return_counts=True)
                pieces.append((ids, times / len(buckets), languages.index(y)))
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight = np.zeros((len(languages), DIM))
    order = rng.permutation(len(pieces))
    held, train = order[: int(len(order) * CALIBRATION)], order[int(len(order) * CALIBRATION) :]
    # rare languages weigh as much as frequent ones
    counts = np.bincount([pieces[i][2] for i in train], minlength=max(1, len(languages)))
    balance = np.sqrt(counts.max(initial=1) / np.maximum(counts, 1))
    steps = max(1, EPOCHS * len(train))
    for t, i in enumerate(np.concatenate([rng.permutation(train) for _ in range(EPOCHS)]) if len(train) else []):
        f, part, y = pieces[i]
        own = embed[f]
        h = part @ own
        z = weight @ h
        g = np.exp(z - z.max())
        g /= g.sum()
        g[y] -= 1
        g *= RATE * (1 - t / steps) * balance[y]
        back = g @ weight
        weight -= np.outer(g, h)
        embed[f] = own - part[:, None] * back
    model = Model(languages, embed, weight)
    if len(held):
        z = np.array([weight @ (pieces[i][1] @ embed[pieces[i][0]]) for i in held])
        y = np.array([pieces[i][2] for i in held])
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        p = _softmax(z / model.temperature)
        sure, right = p.max(1), p.argmax(1) == y
        grid = np.linspace(0, 0.99, 100)
        model.least = float(next((t for t in grid if right[sure >= t].mean() >= PRECISION), grid[-1]) if (sure >= grid[-1]).any() else 0.0)
    return model


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from ``max_rows`` rows (text, lang) with both set, as many of each language as there are.

    Of a language the different texts of least hash are taken; copies count once, so
    that a large group of them leaves room for others, and the sample is the same
    whatever the partitioning.  Hashes alone are ranked, each task keeping the first
    ``max_rows`` of a language; then the whole texts of those taken are fetched.
    """
    good = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    each = Window.partitionBy("lang").orderBy("h")
    ranked = good.select("lang", "h").distinct().withColumn("n", F.row_number().over(each)).where(F.col("n") <= max_rows)
    taken = ranked.orderBy("n", "h", "lang").limit(max_rows).select("lang", "h")
    picked = good.join(F.broadcast(taken), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return fit([(r["text"], r["lang"]) for r in sorted(picked.collect(), key=lambda r: (r["h"], r["lang"]))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row; null texts and texts without letters give ``und``, 0 and true.

    Whole texts are read; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.embed.astype(np.float32), model.weight, model.temperature, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            found = [m.predict(t) for t in map(pa.StringScalar.as_py, b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
