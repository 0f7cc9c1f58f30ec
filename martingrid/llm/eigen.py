"""Symmetric eigenvalue problems: Householder tridiagonal form, then divide and conquer (Cuppen, 1981; Gu and Eisenstat, 1995)."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, q) with a = q T q', T having diagonal d and off-diagonal e."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.abs(v[1:]).max() == 0 or length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Matrix of d_i - lambda_j for the roots lambda of 1 + rho sum z_i^2 / (d_i - lambda), d rising, rho above 0.

    Each root is searched as an offset from its nearer pole, by halving the bit patterns
    between two doubles, so that even tiny differences keep all their digits.
    """
    n, z2 = len(d), rho * z * z
    width = np.append(d[1:] - d[:-1], z2.sum())
    gap = d[:, None] - d[None, :]  # d_i - d_j
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = 1 + (z2[:, None] / (gap - width / 2)).sum(0)
    right = (middle < 0) & (np.arange(n) < n - 1)  # the root lies in the upper half: its offset is from the pole above
    pole = np.arange(n) + right
    base, sign = d[:, None] - d[pole][None, :], np.where(right, -1.0, 1.0)
    low = np.zeros(n, dtype=np.int64)
    high = (np.where(np.arange(n) < n - 1, width / 2, width) * (1 + 4 * _EPS)).view(np.int64)
    for _ in range(64):
        mid = low + (high - low) // 2
        off = np.maximum(mid.view(np.float64), np.finfo(np.float64).tiny) * sign
        with np.errstate(divide="ignore", over="ignore"):
            f = 1 + (z2[:, None] / (base - off)).sum(0)
        up = np.where(right, f > 0, f < 0)  # the root is farther from the pole
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return base - np.maximum(high.view(np.float64), np.finfo(np.float64).tiny) * sign


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', rho above 0."""
    n, order = len(d), np.argsort(d, kind="stable")
    d, z, turn = d[order].copy(), z[order].copy(), np.eye(n)[:, order]
    tol = 8 * _EPS * max(np.abs(d).max(), rho * (z @ z), np.finfo(np.float64).tiny)
    last = -1
    for i in range(n):  # poles that meet are turned into one another, and lose one part of z
        if rho * abs(z[i]) * np.linalg.norm(z) <= tol:
            z[i] = 0
            continue
        if last >= 0:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= tol:
                z[last], z[i] = 0, r
                turn[:, [last, i]] = turn[:, [last, i]] @ np.array([[c, s], [-s, c]])
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
        last = i
    live = np.flatnonzero(z)
    vectors, values = np.eye(n), d.copy()
    if len(live):
        order = live[np.argsort(d[live], kind="stable")]
        dl, zl = d[order], z[order]
        diff = _roots(dl, zl, rho)  # d_i - lambda_j
        ratio = diff.copy()
        gaps = dl[:, None] - dl[None, :]
        np.fill_diagonal(gaps, 1.0)
        ratio /= np.where(np.eye(len(order), dtype=bool), 1.0, gaps)
        zl = np.copysign(np.sqrt(np.abs(ratio.prod(1)) / rho), zl)  # the z for which these roots are exact
        v = zl[:, None] / diff
        vectors[np.ix_(order, order)] = v / np.linalg.norm(v, axis=0)
        near = np.abs(diff).argmin(0)
        values[order] = dl[near] - diff[near, np.arange(len(order))]
    return values, turn @ vectors


def _conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = abs(e[m - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    a, qa = _conquer(upper, e[: m - 1])
    b, qb = _conquer(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = qa, qb
    if rho == 0:
        return np.concatenate([a, b]), q
    z = np.concatenate([qa[-1], np.sign(e[m - 1]) * qb[0]])
    values, vectors = _rank_one(np.concatenate([a, b]), z, rho)
    return values, q @ vectors


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix.

    The sign of a vector is such that its entry of greatest size (the first of equal
    ones) is positive.
    """
    a = np.asarray(a, dtype=np.float64)
    top = np.abs(a).max(initial=0)
    if top == 0:
        return np.zeros(len(a)), np.eye(len(a))
    scale = 2.0 ** np.ceil(np.log2(top))
    d, e, q = tridiagonal(a / scale)
    values, vectors = _conquer(d, e)
    vectors = q @ vectors
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(a))])
    return values[order] * scale, vectors
