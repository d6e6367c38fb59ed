"""Singular values and right singular vectors of a small matrix by differential quotient-difference steps.

Householder reflections make the matrix bidiagonal. Shifted dqds steps find the squares of
the singular values of the bidiagonal with high relative accuracy; every step is made of
sums of positive terms and products, and the shift is always a lower bound of the smallest
value. A twisted factorisation at each value gives its vector without any iteration.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
# Values closer than this, relative to their size, get their vectors together.
_CLOSE = 1e-4


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, the one above it, v) with a = u b v', u orthogonal and not formed."""
    a = np.array(a, dtype=float)
    rows, n = a.shape
    if rows < n:
        a = np.vstack([a, np.zeros((n - rows, n))])
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        h = x.copy()
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not len(x):
            return h, 0.0
        h /= scale
        h[0] += np.copysign(np.linalg.norm(h), h[0])
        return h, 2.0 / (h @ h)

    for k in range(n):
        h, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(h, h @ a[k:, k:])
        if k < n - 2:
            h, beta = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ h, h)
            v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy()[:n - 1], v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float] | None:
    """One dqds step: (q, e, least d, sum of 1 / d), or None where the shift is too large."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least, inverse = d, 0.0
    for k in range(n - 1):
        if d <= 0:
            return None
        inverse += 1.0 / d
        new_q[k] = d + e[k]
        t = q[k + 1] / new_q[k]
        new_e[k] = e[k] * t
        d = d * t - shift
        least = min(least, d)
    if d < 0 or d != d:
        return None
    new_q[-1] = d
    inverse = inverse + 1.0 / d if d > 0 else float("inf")
    return new_q, new_e, least, inverse


def dqds(q: list[float], e: list[float]) -> np.ndarray:
    """The eigenvalues of b'b, largest first; q and e are the squares of b's diagonals."""
    values: list[float] = []
    parts = [(list(q), list(e), 0.0)]
    while parts:
        q, e, base = parts.pop()
        if len(q) > 1 and 1.5 * q[0] < q[-1]:  # small values are found at the end
            q, e = q[::-1], e[::-1]
        shift, rounds, most = 0.0, 0, 100 * (len(q) + 10)
        while len(q) > 1:
            if e[-1] <= _EPS * _EPS * (base + q[-1]):
                values.append(base + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e) - 1) if e[k] <= _EPS * _EPS * (base + min(q[k], q[k + 1]))), None)
            if cut is not None:
                parts.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            done = _step(q, e, shift)
            tries = 0
            while done is None:  # only rounding can make the bound too large
                tries += 1
                shift = 0.0 if tries > 8 else shift * 0.9
                done = _step(q, e, shift)
                if done is None and not shift:
                    done = [max(x, 0.0) for x in q], [0.0] * len(e), 0.0, float("inf")
            q, e, least, inverse = done
            base += shift
            rounds += 1
            # The last step's d are the reciprocals of a diagonal of the inverse matrix: the
            # reciprocal of their sum bounds the least value from below, their least from above.
            # A step succeeds exactly where its shift is below the least value, so bolder shifts
            # between the two are tried first.
            safe = 1.0 / inverse if np.isfinite(inverse) else 0.0
            gap = max(least - safe, 0.0)
            bolder = (least - share * gap for share in (0.002, 0.03, 0.1, 0.3, 0.6)) if gap > 1e-3 * safe else ()
            shift = next((x for x in bolder if _step(q, e, x) is not None), safe)
            if base + shift == base:
                shift = 0.0
            if rounds > most:
                raise ArithmeticError("dqds does not converge")
        values.extend(base + x for x in q)
    return np.sort(np.array(values))[::-1]


def _twisted(big: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The unit vector z with (l d l' - value) z nearly 0; big is d, low the entries under the diagonal of l."""
    n = len(big)
    tiny = np.finfo(float).tiny / _EPS
    s, p = np.empty(n), np.empty(n)
    forward, backward = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + big[i]
        if abs(pivot) < tiny:
            pivot = tiny
        forward[i] = big[i] * low[i] / pivot
        s[i + 1] = forward[i] * low[i] * s[i] - value
    p[-1] = big[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] * low[i] + p[i + 1]
        if abs(pivot) < tiny:
            pivot = tiny
        t = big[i] / pivot
        backward[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    twist = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -forward[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -backward[i] * z[i]
    return z / np.linalg.norm(z)


def _vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of b'b of an unreduced bidiagonal b, as columns in the order of values."""
    n = len(d)
    scale = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    d = np.where(np.abs(d) < _EPS * scale, _EPS * scale, d)
    big, low = d * d, e / d[:-1]
    z = np.stack([_twisted(big, low, v) for v in values], axis=1)
    start = 0
    while start < n:
        end = start + 1
        while end < n and values[end - 1] - values[end] <= _CLOSE * values[end - 1]:
            end += 1
        if end - start > 1:
            z[:, start:end] = _together(d, e, values[start:end], z[:, start:end])
        start = end
    return z


def _together(d: np.ndarray, e: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of values that are close to each other.

    The twisted vectors are made orthogonal; where two are nearly the same, inverse iteration
    on random vectors finds the rest of the space, and a projection onto it sorts it out.
    """
    basis, r = np.linalg.qr(z)
    if np.abs(np.diag(r)).min() > 1e-3:
        return basis
    t = np.diag(d * d + np.r_[0.0, e * e]) + np.diag(d[:-1] * e, 1) + np.diag(d[:-1] * e, -1)
    draw = np.random.default_rng(0)
    basis = np.linalg.qr(draw.normal(size=z.shape))[0]
    shifted = t - np.eye(len(d)) * (values.mean() * (1 + 4 * _EPS))
    for _ in range(4):
        basis = np.linalg.qr(np.linalg.solve(shifted + np.eye(len(d)) * _EPS * np.abs(t).max(), basis))[0]
    own, turn = np.linalg.eigh(basis.T @ t @ basis)
    return basis @ turn[:, ::-1]


def right_singular(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, largest first; right singular vectors as columns) of a."""
    d, e, v = bidiagonal(a)
    n = len(d)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    scale = max(np.abs(d).max(), np.abs(e).max(initial=0.0))
    if scale == 0:
        return np.zeros(n), np.eye(n)
    d, e = d / scale, e / scale
    e = np.where(np.abs(e) <= _EPS * np.sqrt(np.abs(d[:-1] * d[1:])) * 0.5, 0.0, e)
    # What is far below the rounding error of the whole matrix is taken for zero.
    e = np.where(np.abs(e) <= _EPS * _EPS, 0.0, e)
    cuts = np.r_[-1, np.flatnonzero(e == 0), n - 1]
    values, vectors = np.empty(n), np.zeros((n, n))
    for low, high in zip(cuts[:-1] + 1, cuts[1:] + 1):
        if low == high:
            continue
        own = slice(low, high)
        found = dqds((d[own] ** 2).tolist(), (e[low:high - 1] ** 2).tolist())
        values[own] = found
        vectors[own, own] = _vectors(d[own], e[low:high - 1], found)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    real = int((values > (8 * n * _EPS) ** 2 * values[0]).sum())
    if real < n:  # the vectors of what is zero up to rounding: any that are orthogonal to the others
        vectors[:, real:] = np.linalg.qr(np.hstack([vectors[:, :real], np.eye(n)]))[0][:, real:n]
    return values * scale * scale, v @ vectors
