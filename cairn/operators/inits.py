"""Initial centers: first rows, uniform in the bounding box, means of a random partition, and two random mixtures of all points.

Draws come from the congruential generator in row order; as the n-th draw is computed from n alone, the points stay
where they are and each initialiser is one map-side combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import random
from cairn.sources.points import bounds


def first_rows(points: DataFrame, k: int) -> DataFrame:
    """The first k rows: cluster_id, center."""
    return points.where(F.col("row_id") < k).select(F.col("row_id").cast("int").alias("cluster_id"), F.col("features").alias("center"))


def in_box(points: DataFrame, k: int, dim: int, seed: int) -> DataFrame:
    """Uniform draws in the bounding box, center after center."""
    cells = bounds(points, dim).withColumn("cluster_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    r = random.uniform(seed, F.col("cluster_id").cast("long") * dim + F.col("dim") + 1)
    cells = cells.select("cluster_id", "dim", ((F.lit(1.0) - r) * F.col("lo") + r * F.col("hi")).alias("v"))
    return cells.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("dim", "v")))["v"].alias("center"))


def random_partition(points: DataFrame, k: int, dim: int, seed: int) -> DataFrame:
    """Means of a random partition; row i < k begins cluster i."""
    draw = random.uniform_int(seed, F.col("row_id") - k + 1, 0, k - 1)
    label = F.when(F.col("row_id") < k, F.col("row_id").cast("int")).otherwise(draw)
    by = points.withColumn("cluster_id", label).groupBy("cluster_id").agg(*(F.avg(F.get("features", F.lit(i))).alias(f"m{i}") for i in range(dim)))
    return by.select("cluster_id", F.array(*(F.col(f"m{i}") for i in range(dim))).alias("center"))


def _weighted(points: DataFrame, weights: list[Column], dim: int) -> DataFrame:
    drawn = points.select("features", *(w.alias(f"w{c}") for c, w in enumerate(weights)))
    sums = [F.sum(F.col(f"w{c}") * F.get("features", F.lit(i))).alias(f"s{c}_{i}") for c in range(len(weights)) for i in range(dim)]
    one = drawn.agg(*(F.sum(f"w{c}").alias(f"w{c}") for c in range(len(weights))), *sums)
    each = F.array(*(F.struct(F.lit(c).alias("cluster_id"), F.array(*(F.col(f"s{c}_{i}") / F.col(f"w{c}") for i in range(dim))).alias("center")) for c in range(len(weights))))
    return one.select(F.explode(each).alias("c")).select("c.cluster_id", "c.center")


def random_split(points: DataFrame, k: int, dim: int, seed: int) -> DataFrame:
    """Every point is split at random among all clusters; centers are the weighted means."""
    drawn = points.select("features", *(random.uniform(seed, F.col("row_id") * k + c + 1).alias(f"u{c}") for c in range(k)))
    total = sum((F.col(f"u{c}") for c in range(1, k)), F.col("u0"))
    return _weighted(drawn, [F.col(f"u{c}") / total for c in range(k)], dim)


def random_mixture(points: DataFrame, k: int, dim: int, seed: int, n: int) -> DataFrame:
    """Random convex combinations of all n points: a column of draws a center."""
    return _weighted(points, [random.uniform(seed, F.col("row_id") + c * n + 1) for c in range(k)], dim)
