"""Numpy kernels for what DataFrame operations cannot express: small eigenproblems and the contraction solve."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Components up to so many points are solved densely, larger ones by conjugate gradients.
DENSE_POINTS = 3000
CG_TOLERANCE, CG_STEPS = 1e-10, 4000


def symmetric(m: pd.DataFrame) -> np.ndarray:
    """Batched 3x3 matrices from columns xx, xy, xz, yy, yz, zz."""
    c = [m[k].to_numpy(dtype=float) for k in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return np.stack([np.stack([c[0], c[1], c[2]], -1), np.stack([c[1], c[3], c[4]], -1), np.stack([c[2], c[4], c[5]], -1)], -2)


def shape_ratios(m: pd.DataFrame) -> pd.DataFrame:
    """Second and third eigenvalue over the first; zeros where n is below 3."""
    values = np.linalg.eigvalsh(symmetric(m))[:, ::-1] if len(m) else np.empty((0, 3))
    first = np.where(values[:, 0] > 0, values[:, 0], 1.0)
    enough = m["n"].to_numpy() >= 3
    return pd.DataFrame({"r2": np.where(enough, values[:, 1] / first, 0.0), "r3": np.where(enough, values[:, 2] / first, 0.0)})


def lopsidedness(m: pd.DataFrame) -> np.ndarray:
    """Length of the mean neighbour offset in the tangent plane over the mean offset length."""
    if not len(m):
        return np.empty(0)
    normal = np.linalg.eigh(symmetric(m))[1][:, :, 0]
    mean = m[["mx", "my", "mz"]].to_numpy(dtype=float)
    along = (mean * normal).sum(1)
    return np.sqrt(np.maximum(0.0, (mean * mean).sum(1) - along**2)) / (m["mean_len"].to_numpy(dtype=float) + 1e-9)


def least_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component in a graph of nodes 0 to n - 1: roots hang on lesser ones, paths halve."""
    root = np.arange(n)
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        open_ = low != high
        left, right = left[open_], right[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def contract(points: np.ndarray, left: np.ndarray, right: np.ndarray, anchor: np.ndarray, wl: float, growth: float, iterations: int) -> list[np.ndarray]:
    """All iterates of (wl² LᵀL + W²) P' = W² P with wl growing; L is the graph Laplacian, W the anchor weights.

    Raises when conjugate gradients do not reach the tolerance.
    """
    n = len(points)
    degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    frames, place, hold = [points], points, anchor**2
    if n <= DENSE_POINTS:
        lap = np.diag(degree.astype(float))
        lap[left, right] -= 1
        lap[right, left] -= 1
        squared = lap @ lap
        for _ in range(iterations):
            place = np.linalg.solve(wl**2 * squared + np.diag(hold), hold[:, None] * place)
            frames.append(place)
            wl *= growth
        return frames

    def lap_of(x: np.ndarray) -> np.ndarray:
        out = degree[:, None] * x
        for d in range(x.shape[1]):
            out[:, d] -= np.bincount(left, x[right, d], n) + np.bincount(right, x[left, d], n)
        return out

    scale = degree.astype(float) ** 2 + degree
    for _ in range(iterations):
        apply = lambda x, w=wl: w**2 * lap_of(lap_of(x)) + hold[:, None] * x
        precond = 1 / (wl**2 * scale + hold)[:, None]
        goal, x = hold[:, None] * place, place.copy()
        r = goal - apply(x)
        z = precond * r
        p, rz = z.copy(), (r * z).sum(0)
        stop = CG_TOLERANCE * np.maximum(np.linalg.norm(goal, axis=0), 1e-30)
        for _ in range(CG_STEPS):
            if (np.linalg.norm(r, axis=0) <= stop).all():
                break
            q = apply(p)
            step = rz / np.maximum((p * q).sum(0), 1e-300)
            x += step * p
            r -= step * q
            z = precond * r
            new = (r * z).sum(0)
            p = z + new / np.maximum(rz, 1e-300) * p
            rz = new
        else:
            if (np.linalg.norm(r, axis=0) > stop).any():
                raise ArithmeticError(f"the contraction of {n} points did not converge in {CG_STEPS} steps")
        place = x
        frames.append(place)
        wl *= growth
    return frames
