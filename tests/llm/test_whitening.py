import math
from fractions import Fraction

import numpy as np
import pytest

from martingrid.llm import catalog, whitening
from martingrid.llm.eigen import eigen

ROWS = "vec_id long, embedding array<double>, n string"


def plain(vectors, k=4):
    """The contract, with exact sums and the standard eigenvalue routine."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * c - s, n) for c, s in zip(v, sums, strict=True)] for v in fit]
    cov = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(len(sums))] for a in range(len(sums))])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, v in kept:
        d = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)])
        dev = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for c in range(len(e)):
            out.setdefault((i, c + 1), []).append((n, dev, float(d @ u[:, c] / np.sqrt(e[c])), e[c] / np.trace(cov)))
    return out


def same(rows, want):
    have = {}
    for r in rows:
        have.setdefault((r.vec_id, r.component), []).append(r)
    assert have.keys() == want.keys()
    signs = {}
    for key, group in have.items():
        assert len(group) == len(want[key])
        for r, (n, dev, w, explained) in zip(group, want[key], strict=True):
            assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
            assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-6)
            if abs(w) > 1e-3:
                signs.setdefault(key[1], set()).add(np.sign(w) == np.sign(r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_equals_exact_covariance_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [1, 3, 9, 27, 81, 0.1] + 1e6).tolist(), "x") for i in range(60)]
    rows += [rows[0], (0, rows[0][1], "copy"), (90, None, "x"), (91, [1.0, None, 2.0, 3.0, 4.0, 5.0], "x"), (92, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], "x"), (93, [float("inf")] * 6, "x")]
    rows += [(100 + i, rows[3][1], "hot") for i in range(40)]
    df = spark.createDataFrame(rows, ROWS)
    want = plain([r[:2] for r in rows])
    same(whitening.whiten(df).collect(), want)
    same(whitening.whiten(df.repartition(7)).collect(), want)


def test_empty_equal_short_and_vast_vectors(spark):
    def run(vectors):
        return sorted(whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], ROWS)).collect())

    assert run([]) == [] and run([None, []]) == []
    flat = run([[1.0, 2.0]] * 3)
    assert len(flat) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error == 0 for r in flat)
    short = run([[1.0], [1.0, 0.0], [3.0, 5.0]])
    assert {r.n for r in short} == {2} and [r.component for r in short] == [1, 2] * 3
    assert [r.whitened is None for r in short] == [False, True] * 3
    vast = run([[1e18, 1.0], [-1e300, 2.0]])
    assert all(r.deviation is None and abs(r.whitened) == pytest.approx(1) for r in vast if r.component == 1)


def test_covariance_keeps_its_digits_far_from_zero(spark):
    """Tiny differences beside a mean of 2^40: plain sums of squares would leave nothing."""
    rows = [(i, [2.0**40 + (i % 3) / 256, (i % 5) / 256, float(-i * i) / 256], "x") for i in range(15)]
    same(whitening.whiten(spark.createDataFrame(rows, ROWS), 2).collect(), plain([r[:2] for r in rows], 2))


def test_outer_sums_against_fractions():
    rng = np.random.default_rng(3)
    high = rng.standard_normal((50, 3)) * [1e-9, 1, 1e12]
    low = high * 2.0**-54 * rng.standard_normal((50, 3))
    total, rest = whitening.outer_sums(high, low)
    for a in range(3):
        for b in range(3):
            exact = sum((Fraction(x) + Fraction(y)) * (Fraction(u) + Fraction(v)) for x, y, u, v in zip(high[:, a], low[:, a], high[:, b], low[:, b], strict=True))
            size = float(np.abs(high[:, a]).max() * np.abs(high[:, b]).max()) * 50
            assert abs(float(Fraction(total[a, b]) + Fraction(rest[a, b]) - exact)) < size * 2.0**-70


@pytest.mark.parametrize("name", ["random", "repeated", "scaled", "blocks", "rank", "ones"])
def test_divide_and_conquer(name):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 33))
    a = {"random": x.T @ x, "repeated": np.eye(20), "scaled": (x * np.logspace(0, 7, 33)).T @ (x * np.logspace(0, 7, 33)), "blocks": np.kron(np.eye(9), [[2.0, 1], [1, 2]]), "rank": x[:3].T @ x[:3], "ones": -np.ones((17, 17))}[name]
    values, vectors = eigen(a)
    size = np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * size


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    fit = {tuple(math.floor(256 * c) for c in r.embedding) for r in rows}
    got = catalog.op13_embedding_whitening(spark, sf).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {len(fit)} and got[0].identity_error < 1e-9
    same([r for r in got if r.vec_id < 5], {k: v for k, v in plain([tuple(r) for r in rows]).items() if k[0] < 5})
