"""Eigenpairs of a symmetric matrix by contour integration, with counts that none is missed.

An interval's eigenvectors are what remains of a few start vectors when the resolvent (z - V)^-1 is integrated around the
interval: the quadrature solves a complex shifted system at each point of half a circle and adds the real parts.
Rayleigh-Ritz on that subspace gives the pairs, and the subspace is projected again until they stand still. The inertia of
V - s, from a pivoted factorisation, counts the eigenvalues above s: it places the intervals, and it proves that an
interval's pairs are all there.
"""

from __future__ import annotations

import numpy as np

#: Points on the half circle, projections at most, eigenvalues that one interval should hold at most.
POINTS, ROUNDS, WIDTH = 8, 60, 8
#: Residual of a pair, and distance from an interval's end, against the norm of the matrix.
RESIDUAL, NEAR = 2e-14, 1e-12


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above the shift: the positive pivots of P (V - shift) P' = L D L', with blocks of one or two
    chosen by the largest entry that is left."""
    a, count = v - shift * np.eye(len(v)), 0
    while len(a):
        n = len(a)
        top, off = int(np.argmax(np.abs(np.diag(a)))), np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(np.argmax(off)), n)
        if abs(a[top, top]) >= 0.64 * off[i, j]:
            block = [top]
            count += a[top, top] > 0
        else:
            block = [i, j]
            count += 1  # its determinant is negative, so one of its two eigenvalues is positive
        rest = np.setdiff1d(np.arange(n), block)
        if not np.any(a[np.ix_(block, block)]):
            break  # all that is left is zero
        side = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return int(count)


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, which together hold the k largest eigenvalues at least, each
    with WIDTH of them at most, unless more than that stand closer together than NEAR."""
    radius = float(np.abs(v).sum(axis=1).max())
    high, low_end, found, done = radius * 1.001, -radius * 1.001, [], 0
    while done < k:
        want = min(k - done, WIDTH)
        low, top, inside = low_end, high, len(v) - done
        # Halves until the interval holds as many as wanted, or until it can't be told apart any more.
        while inside != want and top - low > NEAR * radius:
            middle = (low + top) / 2
            count = above(v, middle) - done
            if count >= want:
                low, inside = middle, count
            else:
                top = middle
        found.append((low, high, inside))
        done, high = done + inside, low
    return found


def projected(v: np.ndarray, low: float, high: float, inside: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The interval's eigenvalues, falling, and their vectors as columns."""
    n, norm = len(v), float(np.abs(v).sum(axis=1).max())
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (points + 1)
    size = min(n, 2 * inside + 2)
    while True:
        basis, settled = rng.standard_normal((n, size)), False
        for _ in range(ROUNDS):
            total = np.zeros((n, size))
            for angle, weight in zip(angles, weights, strict=True):
                turn = radius * np.exp(1j * angle)
                total += np.real(weight / 2 * turn * np.linalg.solve((middle + turn) * np.eye(n) - v, basis.astype(complex)))
            basis, _ = np.linalg.qr(total / np.maximum(np.linalg.norm(total, axis=0), 1e-300))
            small, turned = np.linalg.eigh(basis.T @ v @ basis)
            basis = basis @ turned
            mine = (small >= low) & (small <= high)
            off = np.linalg.norm(v @ basis[:, mine] - basis[:, mine] * small[mine], axis=0)
            still = mine.sum() == inside and bool(np.all(off <= RESIDUAL * norm))
            if settled and still:  # one projection more takes what rounding had left
                order = np.argsort(-small[mine], kind="stable")
                return small[mine][order], basis[:, mine][:, order]
            settled |= still
        if size == n:
            raise ArithmeticError("the projections don't settle")
        size = min(n, 2 * size)


def top(v: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, each with its largest
    entry positive. Fewer where the matrix has fewer."""
    k = min(k, len(v))
    if not k:
        return np.empty(0), np.empty((len(v), 0))
    scale = float(np.abs(v).max())
    if scale == 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    rng, values, columns = np.random.default_rng(seed), [], []
    for low, high, inside in intervals(v / scale, k):
        found, vectors = projected(v / scale, low, high, inside, rng)
        values.append(found)
        columns.append(vectors)
    values, columns = np.concatenate(values)[:k] * scale, np.concatenate(columns, axis=1)[:, :k]
    signs = np.sign(columns[np.argmax(np.abs(columns), axis=0), np.arange(k)])
    return values, columns * signs
