"""Points against centers: distances, nearest centers, and what follows from an assignment.

Centers are few (k is a parameter), so they stand in the plan as constants: no join, no shuffle of points. Sums over
clusters are aggregations with map-side combine whose shuffle has a row a cluster and task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.vectors import sq_distance, vector
from cairn.operators import kernel

Centers = Sequence[Sequence[float]]
NAN = float("nan")
#: Up to so many coordinates of centers, distances are written out in generated code. Beyond, one method would outgrow
#: what the JVM compiles, and Arrow batches in numpy are faster.
WRITTEN_OUT = 64


def collect_centers(centers: DataFrame) -> list[list[float]]:
    """A centers frame (cluster_id, center) as a list by cluster_id; k rows."""
    return [list(r["center"]) for r in centers.orderBy("cluster_id").collect()]


def centers_frame(points: DataFrame, centers: Centers) -> DataFrame:
    return points.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster_id int, center array<double>")


def distances(points: DataFrame, centers: Centers) -> DataFrame:
    """Every point with every center: row_id, cluster_id, d2."""
    each = F.array(*(F.struct(F.lit(i).alias("cluster_id"), sq_distance(F.col("features"), c).alias("d2")) for i, c in enumerate(centers)))
    return points.select("row_id", F.explode(each).alias("d")).select("row_id", "d.cluster_id", "d.d2")


def written_out(centers: Centers) -> bool:
    return sum(map(len, centers)) <= WRITTEN_OUT


def to_centers(features: Column, centers: Centers) -> Column:
    """Squared distances to all centers as one array."""
    if written_out(centers):
        return F.array(*(sq_distance(features, c) for c in centers))
    return F.transform(F.array(*map(vector, centers)), lambda c: sq_distance(features, c))


def least(d2: Column) -> Column:
    """Struct (d2, cluster_id) of the least distance in an array; the lowest id on ties; NaN never wins; nulls if all are NaN."""
    low = F.array_min(d2)
    known = ~F.isnan(low)
    return F.struct(F.when(known, low).alias("d2"), F.when(known, (F.array_position(d2, low) - 1).cast("int")).alias("cluster_id"))


def nearest(features: Column, centers: Centers) -> Column:
    """Struct (d2, cluster_id) of the nearest center, by the rules of least()."""
    return least(to_centers(features, centers))


def assign(points: DataFrame, centers: Centers) -> DataFrame:
    """Points with cluster_id and d2 of their nearest center (null where no distance is a number)."""
    if not written_out(centers):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        return points.mapInArrow(_assign(centers, points.columns.index("features")), f"{fields}, cluster_id int, d2 double")
    # the array is a column of its own, so that its two uses share one computation
    found = points.select(*points.columns, to_centers(F.col("features"), centers).alias("__d2"))
    near = least(F.col("__d2"))
    return found.select(*points.columns, near["cluster_id"].alias("cluster_id"), near["d2"].alias("d2"))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column as rows, and which rows of the column they are (those that are not null)."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return x.reshape(len(there), -1) if len(there) else np.empty((0, 0)), there


def _assign(centers: Centers, at: int):
    c = np.array(centers, dtype=np.float64)

    def run(batches):
        for b in batches:
            x, there = matrix(b.column(at))
            cluster, low = np.full(b.num_rows, -1, dtype=np.int32), np.full(b.num_rows, np.nan)
            if len(there):
                d2 = kernel.sq_distances(x, c)
                cluster[there] = near = kernel.assign(d2)
                low[there] = d2[np.arange(len(x)), np.maximum(near, 0)]
            none = cluster < 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster, mask=none), pa.array(low, mask=none)], names=[*b.schema.names, "cluster_id", "d2"])

    return run


def _every(found: DataFrame, k: int) -> DataFrame:
    """Left join from all cluster ids, so that empty clusters stay."""
    return found.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id")).join(F.broadcast(found), "cluster_id", "left")


def centroids(assigned: DataFrame, k: int, dim: int) -> DataFrame:
    """cluster_id, n, center (mean of every dimension; NaN for an empty cluster), sse."""
    sums = [F.sum(F.get("features", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    by = assigned.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("d2").alias("sse"), *sums)
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(NAN))
    return _every(by, k).select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"), F.array(*(mean(f"s{i}") for i in range(dim))).alias("center"), F.coalesce("sse", F.lit(0.0)).alias("sse"))


def member_counts(assigned: DataFrame, k: int) -> DataFrame:
    by = assigned.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return _every(by, k).select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def total_distance(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances to the assigned centers; unassigned points are skipped."""
    return assigned.where("cluster_id is not null").agg(F.coalesce(F.sum("d2"), F.lit(0.0)).alias("total"))


def cluster_energy(assigned: DataFrame, k: int) -> DataFrame:
    """Sum of squared distances of every cluster; 0 for an empty one."""
    by = assigned.where("cluster_id is not null").groupBy("cluster_id").agg(F.sum("d2").alias("energy"))
    return _every(by, k).select("cluster_id", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def chunk_variance(assigned: DataFrame, k: int, size: int) -> DataFrame:
    """Energy of every cluster over the chunk's size (not the cluster's)."""
    return cluster_energy(assigned, k).select("cluster_id", (F.col("energy") / F.lit(float(size))).alias("var"))


def cluster_variance(assigned: DataFrame, k: int) -> DataFrame:
    """Energy of every cluster over its own population; 0 for an empty one."""
    by = assigned.where("cluster_id is not null").groupBy("cluster_id").agg(F.avg("d2").alias("var"))
    return _every(by, k).select("cluster_id", F.coalesce("var", F.lit(0.0)).alias("var"))


def summary(assigned: DataFrame, k: int) -> DataFrame:
    """A report row a cluster, and a total row with cluster_id null: population, energy, variance and whole percentages."""
    by = assigned.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("population"), F.sum("d2").alias("energy"))
    rows = _every(by, k).select("cluster_id", F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("energy", F.lit(0.0)).alias("energy"))
    rows = rows.withColumn("variance", F.when(F.col("population") > 0, F.col("energy") / F.greatest("population", F.lit(1))).otherwise(0.0))
    sums = rows.agg(F.sum("population").alias("p"), F.sum("energy").alias("e"), F.sum("variance").alias("v"), F.sum(F.col("population") * F.col("variance")).alias("pv"))
    share = lambda c, of: F.when(F.col(of) > 0, F.floor(F.col(c) * 100 / F.when(F.col(of) > 0, F.col(of)))).otherwise(0).cast("int")
    each = rows.join(F.broadcast(sums)).select("cluster_id", "population", share("population", "p").alias("population_pc"), "energy", share("energy", "e").alias("energy_pc"), "variance", share("variance", "v").alias("variance_pc"))
    weighted = F.when(F.col("p") > 0, F.col("pv") / F.greatest("p", F.lit(1))).otherwise(0.0)
    last = sums.select(F.lit(None).cast("int").alias("cluster_id"), F.col("p").alias("population"), F.lit(100).alias("population_pc"), F.col("e").alias("energy"), F.lit(100).alias("energy_pc"), weighted.alias("variance"), F.lit(100).alias("variance_pc"))
    return each.unionByName(last)


def change_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose cluster differs between two assignments, joined on row_id."""
    a, b = before.select("row_id", F.col("cluster_id").alias("was")), after.select("row_id", "cluster_id")
    return a.join(b, "row_id").agg(F.coalesce(F.sum((~F.col("was").eqNullSafe(F.col("cluster_id"))).cast("long")), F.lit(0)).alias("n_changed"))


def change_count_of(points: DataFrame, before: Centers, after: Centers) -> DataFrame:
    """change_count for two sets of centers of the same points: one scan, no join."""
    was = assign(points.select("features"), before).select("features", F.col("cluster_id").alias("was"))
    both = assign(was, after).select((~F.col("was").eqNullSafe(F.col("cluster_id"))).cast("long").alias("x"))
    return both.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n_changed"))


def move_scores(assigned: DataFrame, centers: Centers, counts: Sequence[int]) -> DataFrame:
    """What moving a point to each cluster costs: d2 * n / (n + 1), and d2 * n / (n - 1) for the cluster it is in.

    Takes row_id, features, cluster_id. Returns row_id, to_cluster, score; a point alone in its cluster scores 0 there.
    """
    def score(i: int) -> Column:
        n, d = counts[i], sq_distance(F.col("features"), centers[i])
        own = d * F.lit(n / (n - 1)) if n > 1 else F.lit(0.0)
        return F.when(F.col("cluster_id") == i, own).otherwise(d * F.lit(n / (n + 1)))

    each = F.array(*(F.struct(F.lit(i).alias("to_cluster"), score(i).alias("score")) for i in range(len(centers))))
    return assigned.select("row_id", F.explode(each).alias("s")).select("row_id", "s.to_cluster", "s.score")


def move(state: DataFrame, features: Sequence[float], source: int, target: int) -> DataFrame:
    """Counts and centers (cluster_id, n, center) after one point goes from a cluster to another."""
    x = F.array(*(F.lit(float(v)) for v in features))
    less = F.when(F.col("n") > 1, F.zip_with("center", x, lambda c, v: c - (v - c) / F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(F.col("center"))
    more = F.zip_with("center", x, lambda c, v: c + (v - c) / (F.col("n") + 1))
    center = F.when(F.col("cluster_id") == source, less).when(F.col("cluster_id") == target, more).otherwise(F.col("center"))
    n = F.col("n") - F.when(F.col("cluster_id") == source, 1).otherwise(0) + F.when(F.col("cluster_id") == target, 1).otherwise(0)
    if source == target:
        return state
    # two steps: in one, a lambda would take the new n for the old
    return state.select("cluster_id", "n", center.alias("center")).select("cluster_id", n.alias("n"), "center")
