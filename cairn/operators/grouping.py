"""Chunk-level clusters merged into groups, and the groups' members."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.lineage import cut
from cairn.operators import kernel
from cairn.operators.assign import matrix

#: Centroids that the grouping step holds on the driver at a time.
MAX_CENTROIDS = 100_000
#: Rows of the group map up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def greedy_groups(centroids: Sequence[tuple[int, Sequence[float], float]]) -> dict[int, int]:
    """centroid_id to group_id from (centroid_id, center, var).

    In rising order every centroid without a group leads a new one, and takes all later ones without a group whose
    squared distance to it is below its var. Members take nobody; a NaN center stays alone.
    """
    rows = sorted(centroids, key=lambda r: r[0])
    ids = [r[0] for r in rows]
    c = np.array([list(r[1]) for r in rows], dtype=float)
    group = np.full(len(rows), -1)
    n = 0
    for j in range(len(rows)):
        if group[j] >= 0:
            continue
        group[j] = n
        rest = j + 1 + np.flatnonzero(group[j + 1 :] < 0)
        if len(rest):
            d = c[rest] - c[j]
            with np.errstate(invalid="ignore"):
                group[rest[np.einsum("ij,ij->i", d, d) < rows[j][2]]] = n
        n += 1
    return dict(zip(ids, group.tolist()))


def group_map(centroids: DataFrame, most: int = MAX_CENTROIDS) -> DataFrame:
    """greedy_groups of a frame (centroid_id, center, var) of any size: centroid_id, group_id.

    The driver holds `most` centroids at a time: the first ones without a group are grouped there; their leaders then
    take members among all the rest, in tasks; and so on with the next ones that are still without a group. That is the
    same as one pass in order, as a leader takes members regardless of later leaders.
    """
    spark, kind = centroids.sparkSession, "centroid_id long, group_id int"
    rest, done, n = centroids.select(F.col("centroid_id").cast("long").alias("centroid_id"), "center", "var"), None, 0
    while True:
        rows = rest.orderBy("centroid_id").limit(most + 1).collect()
        more, rows = len(rows) > most, [(r["centroid_id"], r["center"], r["var"]) for r in rows[:most]]
        found = greedy_groups(rows)
        here = spark.createDataFrame(sorted((i, g + n) for i, g in found.items()), kind)
        done = here if done is None else done.union(here)
        if not more:
            return done
        leaders: dict[int, tuple] = {}
        for r in rows:
            leaders.setdefault(found[r[0]], (list(r[1]), r[2]))
        first = [leaders[g] for g in range(len(leaders))]
        later = rest.where(F.col("centroid_id") > rows[-1][0])
        later = cut(later.mapInArrow(_taken(np.array([c for c, _ in first], dtype=float), np.array([v for _, v in first], dtype=float), n), "centroid_id long, center array<double>, var double, group_id int"))
        done = done.union(later.where("group_id is not null").select("centroid_id", "group_id"))
        rest, n = later.where("group_id is null").drop("group_id"), n + len(first)


def _taken(centers: np.ndarray, var: np.ndarray, n: int):
    """Adds the group of the first leader that takes each centroid; leaders are the groups n, n + 1, ..."""

    def run(batches):
        for b in batches:
            x, there = matrix(b.column(1))
            group = np.full(b.num_rows, -1, dtype=np.int64)
            step = max(1, 4_000_000 // max(1, len(centers)))  # distances to all leaders are held at once
            for i in range(0, len(x), step):
                with np.errstate(invalid="ignore"):
                    near = kernel.sq_distances(x[i : i + step], centers) < var
                hit = near.argmax(axis=1)
                group[there[i : i + step]] = np.where(near[np.arange(len(near)), hit], hit + n, -1)
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(3)), pa.array(group.astype(np.int32), mask=group < 0)], names=[*b.schema.names, "group_id"])

    return run


def group_sizes(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of every group: group_id, nb_members, from (centroid_id, n) and the group map."""
    return groups.join(counts, "centroid_id", "left").groupBy("group_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nb_members"))


def member_index(rows: DataFrame, groups: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Place of every row in its group by rising row_id: group_id, row_id, member_idx.

    Places are counted in ranges of rows first, so that a window holds one range of one group, never a whole group.
    """
    side = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    placed = rows.join(side, "centroid_id").select("group_id", "row_id", F.floor(F.col("row_id") / chunk).alias("range"))
    sums = placed.groupBy("group_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("group_id").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    place = F.row_number().over(W.partitionBy("group_id", "range").orderBy("row_id")) - 1
    sums = sums.select("group_id", "range", before.alias("before"))
    return placed.withColumn("place", place).join(sums, ["group_id", "range"]).select("group_id", "row_id", (F.col("before") + F.col("place")).cast("long").alias("member_idx"))
