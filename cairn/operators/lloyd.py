"""Farthest-first centers and Lloyd passes over points of any number.

Every step is one scan with a map-side combined aggregation of k rows; only centers come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import kernel
from cairn.operators.assign import Centers, matrix
from cairn.operators.kernel import MAX_PASSES, TooFewPoints

#: A total may exceed the one before by this share before it counts as worse: partial sums come in any order.
TOLERANCE = 1e-12


def row(points: DataFrame, row_id: int) -> list[float]:
    """Features of a row."""
    found = points.where(F.col("row_id") == row_id).select("features").first()
    if found is None:
        raise TooFewPoints(f"no row {row_id}")
    return list(found["features"])


def farthest(points: DataFrame, chosen: Centers) -> tuple[int, list[float], float] | None:
    """Row, features and squared distance of the point farthest from its nearest chosen center; the lowest row on ties.

    Distances are computed on Arrow batches, and a task returns one row.
    """
    parts = points.select("row_id", "features").mapInArrow(_farthest(chosen), "d2 double, row_id long, features array<double>")
    best = parts.agg(F.max(F.struct("d2", (-F.col("row_id")).alias("order"), "features")).alias("r")).first()["r"]
    return None if best is None else (-best["order"], list(best["features"]), best["d2"])


def _farthest(chosen: Centers):
    c = np.array(chosen, dtype=np.float64)

    def run(batches):
        best = None
        for b in batches:
            x, there = matrix(b.column(1))
            if not len(x):
                continue
            d2 = kernel.sq_distances(x, c)
            low = np.where(np.isnan(d2), np.inf, d2).min(axis=1)
            low[np.isinf(low)] = -1  # no distance is a number
            rows = b.column(0).to_numpy(zero_copy_only=False)[there]
            i = np.flatnonzero(low == low.max())
            i = i[rows[i].argmin()]
            if low[i] >= 0 and (best is None or (low[i], -rows[i]) > (best[0], -best[1])):
                best = (float(low[i]), int(rows[i]), x[i].tolist())
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.list_(pa.float64()))], names=["d2", "row_id", "features"])

    return run


def farthest_first(points: DataFrame, k: int, first: int = 1) -> list[tuple[int, list[float]]]:
    """Rows and features of k centers, beginning with row `first`; a scan a center."""
    chosen = [(first, row(points, first))]
    while len(chosen) < k:
        found = farthest(points, [c for _, c in chosen])
        if found is None or not found[2] > 0:
            raise TooFewPoints(f"{len(chosen)} distinct points cannot give {k} centers")
        chosen.append(found[:2])
    return chosen


def lloyd(points: DataFrame, centers: Centers, passes: int = MAX_PASSES) -> tuple[list[list[float]], int]:
    """Centers and finished passes, by the rules of the in-task form; totals are compared with a tolerance.

    A pass is one scan, which gives the total distance to the moved centers, the number of points that changed, and the
    next means.
    """
    now, best, done = np.array(centers, dtype=np.float64), float("inf"), 0
    moved = _pass(points, now, now)[2]
    while done < passes:
        total, changed, ahead = _pass(points, now, moved)
        if total > best * (1 + TOLERANCE):
            break
        now = moved
        if not changed:
            break
        moved, best, done = ahead, total, done + 1
    return now.tolist(), done


_SUMS = pa.schema([("cluster_id", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("changed", pa.int64()), ("sums", pa.list_(pa.float64()))])


def _partial(now: np.ndarray, moved: np.ndarray):
    """A task's sums by new cluster, in k rows."""

    def run(batches):
        k, dim = moved.shape
        n, total, changed, sums = np.zeros(k + 1, dtype=np.int64), np.zeros(k + 1), np.zeros(k + 1, dtype=np.int64), np.zeros((k + 1, dim))
        for b in batches:
            x, _ = matrix(b.column(0))
            if not len(x):
                continue
            was, d2 = kernel.assign(kernel.sq_distances(x, now)), kernel.sq_distances(x, moved)
            new = kernel.assign(d2)
            own = np.where(was >= 0, d2[np.arange(len(x)), was], 0)
            at = np.where(new >= 0, new, k)
            n += np.bincount(at, minlength=k + 1)
            total += np.bincount(at, weights=own, minlength=k + 1)
            changed += np.bincount(at, weights=was != new, minlength=k + 1).astype(np.int64)
            for j in range(dim):
                sums[:, j] += np.bincount(at, weights=x[:, j], minlength=k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(n), pa.array(total), pa.array(changed), pa.array(sums.tolist(), pa.list_(pa.float64()))], schema=_SUMS)

    return run


def _pass(points: DataFrame, now: np.ndarray, moved: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Total distance of points to the moved centers of their old clusters, points that change, means of the new clusters.

    Distances are computed on Arrow batches; k rows a task are shuffled. An empty cluster's mean is NaN.
    """
    k, dim = moved.shape
    parts = points.select("features").mapInArrow(_partial(now, moved), "cluster_id int, n long, total double, changed long, sums array<double>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    total, changed, means = 0.0, 0, np.full((k, dim), np.nan)
    for r in parts.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("changed").alias("changed"), *sums).orderBy("cluster_id").collect():
        total, changed = total + r["total"], changed + r["changed"]
        if r["cluster_id"] < k and r["n"]:
            means[r["cluster_id"]] = [r[f"s{i}"] / r["n"] for i in range(dim)]
    return total, changed, means
