"""Clustering of points that fit one task: farthest-first centers, then Lloyd passes, in numpy."""

from __future__ import annotations

import numpy as np

MAX_PASSES = 150
_BLOCK = 4096


class TooFewPoints(ValueError):
    """Fewer distinct points than centers."""


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points to centers, by differences (no expansion, which would lose digits)."""
    out = np.empty((len(c), len(x))).T  # a column a center, each contiguous
    for i in range(0, len(x), _BLOCK):  # blocks stay in the processor's cache
        for j, center in enumerate(c):
            d = x[i : i + _BLOCK] - center
            out[i : i + _BLOCK, j] = np.einsum("ij,ij->i", d, d)
    return out


def farthest_first(x: np.ndarray, k: int, first: int) -> list[int]:
    """Rows of the centers: `first`, then each time the row farthest from all chosen ones; the lowest row on ties."""
    if not len(x):
        raise TooFewPoints("no points")
    chosen = [first % len(x)]
    d = x - x[chosen[0]]
    near = np.einsum("ij,ij->i", d, d)
    for _ in range(k - 1):
        best = int(np.nanargmax(near)) if not np.isnan(near).all() else 0
        if not near[best] > 0:
            raise TooFewPoints(f"{len(chosen)} distinct points cannot give {k} centers")
        chosen.append(best)
        d = x - x[best]
        near = np.minimum(near, np.einsum("ij,ij->i", d, d))
    return chosen


def assign(d2: np.ndarray) -> np.ndarray:
    """Nearest center of each row; the lowest on ties; -1 where no distance is a number."""
    d = np.where(np.isnan(d2), np.inf, d2)
    best = d.argmin(axis=1)
    return np.where(np.isinf(d[np.arange(len(d)), best]), -1, best)


def means(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Mean of each cluster's rows; NaN for an empty one."""
    inside = cluster >= 0
    n = np.bincount(cluster[inside], minlength=k)
    sums = np.stack([np.bincount(cluster[inside], weights=x[inside, j], minlength=k) for j in range(x.shape[1])], axis=1)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], np.nan)


def lloyd(x: np.ndarray, centers: np.ndarray, passes: int = MAX_PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """Centers, clusters of the rows and finished passes.

    A pass moves centers to means and reassigns. It ends when no row changes; when the total distance grew, with the
    assignment before; or after `passes`, when the clusters are one step newer than the centers.
    """
    k = len(centers)
    now = assign(sq_distances(x, centers))
    was, best, done = now, np.inf, 0
    while done < passes:
        centers = means(x, now, k)
        d2 = sq_distances(x, centers)
        inside = now >= 0
        total = d2[np.flatnonzero(inside), now[inside]].sum()
        if total > best:
            return means(x, was, k), was, done
        was, now = now, assign(d2)
        if (now == was).all():
            break
        best, done = total, done + 1
    return centers, now, done


def energies(x: np.ndarray, centers: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Sum of squared distances of each cluster."""
    inside = np.flatnonzero(cluster >= 0)
    d = x[inside] - centers[cluster[inside]]
    return np.bincount(cluster[inside], weights=np.einsum("ij,ij->i", d, d), minlength=len(centers))
