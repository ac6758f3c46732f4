"""Singular values and right singular vectors of a small upper triangular matrix, accurately, by the qd way.

Householder reflections make the matrix bidiagonal; dqds (differential quotient-difference steps with shifts from below)
finds all singular values; a twisted factorisation of the bidiagonal's Gram matrix gives the vector of each one.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors): r = U B V' with V the reflectors' product, the k-th acting from place k + 1 on."""
    a = r.astype(np.float64).copy()
    n, right = len(a), []
    for k in range(n):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """v, of length sqrt(2) or zero, such that x - v (v'x) is a multiple of the first unit vector."""
    top = np.abs(x).max(initial=0.0)
    if top == 0 or not np.abs(x[1:]).max(initial=0.0):
        return np.zeros_like(x)
    v = x / top
    v[0] += math.copysign(np.sqrt(v @ v), v[0])
    return v * np.sqrt(2 / (v @ v))


def rotate_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z for the reflectors of ``bidiagonalise``; z may hold several columns."""
    z = z.copy()
    for k in reversed(range(len(right))):
        v = right[k]
        z[k + 1 :] -= np.outer(v, v @ z[k + 1 :]).reshape(z[k + 1 :].shape)
    return z


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One step with ``shift``: new q and e, the least d (negative: the shift was too large), and the sum of 1 / d."""
    d = q[0] - shift
    least, inverse = d, 1 / d if d > 0 else math.inf
    new_q, new_e = [], []
    for i in range(len(e)):
        qi = d + e[i]
        if qi == 0:
            return q, e, -1.0, math.inf
        t = q[i + 1] / qi
        new_q.append(qi)
        new_e.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
        inverse += 1 / d if d > 0 else math.inf
    new_q.append(d)
    return new_q, new_e, least, inverse


def singular_squares(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squares of an upper bidiagonal matrix's singular values, falling, each to a few units in the last place.

    A step without a shift tells the sum of 1 / d, the trace of the inverse, so that its reciprocal is a lower bound of the
    smallest value: as a shift it is never too large, and it converges quadratically.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(superdiagonal).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    out: list[float] = []
    todo = [(((diagonal / scale) ** 2).tolist(), ((superdiagonal / scale) ** 2).tolist(), 0.0)]
    tiny = EPS * EPS
    while todo:
        q, e, sigma = todo.pop()
        rest = 0.0  # what sigma lost in rounding
        while q:
            if len(q) == 1:
                out.append(max(0.0, sigma + (rest + q[0])))
                break
            cut = next((i for i in reversed(range(len(e))) if e[i] <= tiny * (sigma + min(q[i], q[i + 1])) or e[i] < 1e-290), None)
            if cut == len(e) - 1:
                out.append(max(0.0, sigma + (rest + q.pop())))
                e.pop()
                continue
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma + rest))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            q, e, least, inverse = _dqds(q, e, 0.0)
            if least <= 0:
                q[-1] = max(q[-1], 0.0)
                if q[-1] == 0.0:  # an exact zero leaves at the bottom
                    e[-1] = 0.0
                continue
            shift = min(1 / inverse, least)
            for part in (1.0, 0.9, 0.5):
                new = _dqds(q, e, shift * part)
                if new[2] >= 0:
                    q, e = new[0], new[1]
                    before = sigma
                    sigma = sigma + (shift * part + rest)
                    rest = (shift * part + rest) - (sigma - before)
                    break
    return np.sort(np.array(out))[::-1] * scale * scale


def twisted_vector(a: np.ndarray, b: np.ndarray, square: float) -> tuple[np.ndarray, float]:
    """(z, gap): the unit vector of B'B nearest to the eigenvalue ``square``, B upper bidiagonal with a and b; gap corrects ``square``.

    B'B - square is factored from the top and from the bottom; both meet where the twist is smallest, and z follows from
    there by multiplications alone.
    """
    n = len(a)
    d, low = a * a, b / a[:-1]
    top, l_plus = np.empty(n), np.empty(n - 1)
    s = -square
    for i in range(n - 1):
        top[i] = s
        pivot = d[i] + s
        pivot = pivot if pivot else EPS * square
        l_plus[i] = d[i] * low[i] / pivot
        s = l_plus[i] * low[i] * s - square
    top[n - 1] = s
    bottom, u_minus = np.empty(n), np.empty(n - 1)
    p = d[n - 1] - square
    for i in range(n - 2, -1, -1):
        bottom[i + 1] = p
        pivot = d[i] * low[i] * low[i] + p
        pivot = pivot if pivot else EPS * square
        t = d[i] / pivot
        u_minus[i] = low[i] * t
        p = p * t - square
    bottom[0] = p
    twist = top + bottom + square
    k = int(np.abs(twist).argmin())
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -l_plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -u_minus[i] * z[i]
    size = z @ z
    return z / math.sqrt(size), float(twist[k] / size)


def _split(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that no superdiagonal entry ties together."""
    cuts = np.flatnonzero(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])) / 4) + 1
    edges = [0, *cuts.tolist(), len(a)]
    return list(zip(edges, edges[1:], strict=False))


def _inverse_iteration(a: np.ndarray, b: np.ndarray, square: float, before: np.ndarray, seed: int) -> np.ndarray:
    """A vector for ``square`` beside those of its cluster (rows of ``before``): shifted inverse iteration kept orthogonal to them."""
    n = len(a)
    gram = np.diag(a * a + np.r_[0.0, b * b]) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    shifted = gram - (square + EPS * max(square, np.abs(gram).max()) * 4) * np.eye(n)
    z = np.random.default_rng(seed).standard_normal(n)
    for _ in range(4):
        for _ in range(2):
            z -= before.T @ (before @ z)
        z = np.linalg.solve(shifted, z / np.sqrt(z @ z))
    for _ in range(2):
        z -= before.T @ (before @ z)
    return z / np.sqrt(z @ z)


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values of ``r``, falling; unit right singular vectors of the first ``k`` as columns).

    Values that lie closer than a millionth apart form a cluster, whose vectors are kept orthogonal. Vectors point so that
    their largest entry is positive.
    """
    n = len(r)
    if not n:
        return np.empty(0), np.empty((0, 0))
    a, b, right = bidiagonalise(r)
    if not np.isfinite(a).all() or not np.isfinite(b).all():
        raise ValueError("entries beyond double precision")
    a = np.where(a == 0, EPS * EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0), 1e-290), a)
    found = []
    for lo, hi in _split(a, b):
        mine, over = a[lo:hi], b[lo : hi - 1]
        cluster = np.empty((0, hi - lo))
        last = math.inf
        for nth, square in enumerate(singular_squares(mine, over)[:k]):
            cluster = cluster if last - square <= 1e-6 * last else np.empty((0, hi - lo))
            last = square
            if hi - lo == 1:
                z = np.ones(1)
            elif len(cluster):
                z = _inverse_iteration(mine, over, square, cluster, nth)
            else:
                z, gap = twisted_vector(mine, over, square)
                if abs(gap) > 16 * EPS * square:
                    z, _ = twisted_vector(mine, over, square + gap)
            cluster = np.vstack([cluster, z])
            found.append((square, lo, z))
    squares = np.sort(np.concatenate([singular_squares(a[lo:hi], b[lo : hi - 1]) for lo, hi in _split(a, b)]))[::-1]
    found.sort(key=lambda f: (-f[0], f[1]))
    z = np.zeros((n, min(k, n)))
    for column, (_, lo, part) in enumerate(found[:k]):
        z[lo : lo + len(part), column] = part
    v = rotate_back(z, right)
    return squares, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
