"""Leading eigenpairs of a small symmetric matrix: Householder tridiagonalisation, bisection by Sturm counts, and inverse
iteration with reorthogonalisation within clusters. All in doubles; the matrix is a covariance, of dimension by dimension.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the largest one make a cluster, whose vectors are kept orthogonal one to another.
NEAR = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal, and the reflections (first row, unit vector) that lead from a to them."""
    a, n, turns = np.array(a, float), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if size == 0 or not np.abs(x[1:]).max():
            continue
        x /= size
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        v = x / np.sqrt(x @ x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= (p @ v) * v
        rest -= 2 * np.outer(v, p)
        rest -= 2 * np.outer(p, v)
        column = a[k + 1 :, k]
        column -= 2 * (v @ column) * v
        a[k, k + 1 :] = column
        turns.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), turns


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each of `at`: negative terms of the Sturm sequence."""
    squares = e * e
    count, q = np.zeros(len(at), int), np.full(len(at), np.inf)
    for i in range(len(d)):
        q = d[i] - at - (squares[i - 1] if i else 0.0) / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: each is bisected until its bounds are neighbouring numbers."""
    n = len(d)
    reach = np.zeros(n)
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    size = max(np.abs(d).max() + reach.max(), np.finfo(float).tiny)
    low, high = np.full(k, (d - reach).min() - EPS * size), np.full(k, (d + reach).max() + EPS * size)
    rank = n - np.arange(k)  # the j-th largest is the last one for which so few lie below
    least = EPS * EPS * size
    for _ in range(200):
        middle = (low + high) / 2
        live = (middle > low) & (middle < high)
        if not live.any():
            break
        up = below(d, e, middle, least) < rank
        low, high = np.where(live & up, middle, low), np.where(live & ~up, middle, high)
    return (low + high) / 2


def _solved(d: np.ndarray, e: np.ndarray, at: float, b: np.ndarray, least: float) -> np.ndarray:
    """x of (T - at) x = b, by elimination with row exchanges; pivots under `least` count as `least`."""
    n = len(d)
    a0, a1, a2, x = (d - at).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low, nxt, over = float(e[i]), a0[i + 1], a1[i + 1]
        if abs(low) > abs(a0[i]):
            f = a0[i] / low
            a0[i + 1], a1[i + 1] = a1[i] - f * nxt, a2[i] - f * over
            a0[i], a1[i], a2[i] = low, nxt, over
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            a0[i] = a0[i] if abs(a0[i]) >= least else least
            f = low / a0[i]
            a0[i + 1] = nxt - f * a1[i]
            a1[i + 1] = over - f * a2[i]
            x[i + 1] -= f * x[i]
    a0[-1] = a0[-1] if abs(a0[-1]) >= least else least
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (a1[i] * x[i + 1] if i + 1 < n else 0.0) - (a2[i] * x[i + 2] if i + 2 < n else 0.0)) / a0[i]
    return np.array(x)


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling values."""
    n, size = len(d), max(np.abs(values).max(initial=0), np.abs(d).max(), np.finfo(float).tiny)
    random = np.random.default_rng(0)
    out, cluster = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > NEAR * size:
            cluster = j
        mates = out[:, cluster:j]
        x = random.standard_normal(n)
        for turn in range(8):
            for _ in range(2):  # twice is enough
                x -= mates @ (mates.T @ x)
            x /= np.sqrt(x @ x)
            if turn > 2 and np.abs(_times(d, e, x) - value * x).max() <= 8 * EPS * size:
                break
            x = _solved(d, e, value, x, EPS * size)
            x /= np.abs(x).max()
        out[:, j] = x / np.sqrt(x @ x)
    return out


def _times(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = d * x
    out[:-1] += e * x[1:]
    out[1:] += e * x[:-1]
    return out


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of symmetric a, falling, and their unit eigenvectors as columns."""
    size = np.abs(a).max(initial=0)
    k = min(k, len(a))
    if k == 0 or size == 0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    d, e, turns = tridiagonal(a / size)
    values = leading(d, e, k)
    v = vectors(d, e, values)
    for first, turn in reversed(turns):
        v[first:] -= 2 * np.outer(turn, turn @ v[first:])
    return values * size, v
