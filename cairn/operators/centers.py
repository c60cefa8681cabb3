"""Operators on sets of centers and partial means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.vectors import sq_distance
from cairn.operators.lloyd import farthest, row


def inter_centroid(centers: DataFrame) -> DataFrame:
    """Sum of squared distances over all pairs of centers (k is small)."""
    b = centers.select(F.col("cluster_id").alias("other"), F.col("center").alias("to"))
    pairs = centers.join(b, F.col("cluster_id") < F.col("other"))
    return pairs.agg(F.coalesce(F.sum(sq_distance(F.col("center"), F.col("to"))), F.lit(0.0)).alias("total"))


def sort_centers(centers: DataFrame) -> DataFrame:
    """Centers numbered by falling first coordinate: rank, cluster_id, center."""
    from pyspark.sql import Window as W

    order = W.orderBy(F.desc(F.get("center", F.lit(0))), "cluster_id")
    return centers.select((F.row_number().over(order) - 1).alias("rank"), "cluster_id", "center")


def compare(solution: DataFrame, found: DataFrame) -> DataFrame:
    """Square root of the summed squared distances of centers with the same cluster_id."""
    pairs = solution.select("cluster_id", F.col("center").alias("wanted")).join(found, "cluster_id")
    return pairs.agg(F.sqrt(F.sum(sq_distance(F.col("wanted"), F.col("center")))).alias("distance"))


def read_solution(spark, path: str, dim: int) -> DataFrame:
    """Centers from a file with a number a line, row after row."""
    from cairn.functions.text import prefix_real
    from cairn.sources.points import numbered_lines

    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    by = lines.groupBy(F.floor(F.col("row_id") / dim).cast("int").alias("cluster_id"))
    return by.agg(F.sort_array(F.collect_list(F.struct("row_id", prefix_real(F.col("value")).alias("v"))))["v"].alias("center"))


def partial_means(points: DataFrame, size: int, dim: int) -> DataFrame:
    """Mean vector of every chunk of rows: chunk_id, n, mean."""
    by = points.groupBy(F.floor(F.col("row_id") / size).alias("chunk_id"))
    by = by.agg(F.count("*").alias("n"), *(F.avg(F.get("features", F.lit(i))).alias(f"m{i}") for i in range(dim)))
    return by.select("chunk_id", "n", F.array(*(F.col(f"m{i}") for i in range(dim))).alias("mean"))


def farthest_mean(means: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """The chunk not chosen whose mean has the largest summed distance to the chosen ones: chunk_id, total; 0 if there is none."""
    taken = F.col("chunk_id").isin(list(chosen))
    picked = [r["mean"] for r in means.where(taken).select("mean").orderBy("chunk_id").collect()]
    far = (sq_distance(F.col("mean"), m) for m in picked)
    sums = means.where(~taken & F.lit(bool(picked))).select("chunk_id", sum(far, F.lit(0.0)).alias("total"))
    best = sums.agg(F.max(F.struct("total", (-F.col("chunk_id")).alias("order"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.order"), F.lit(0)).cast("long").alias("chunk_id"), F.col("b.total").alias("total"))


def dispersion(points: DataFrame, first: int = 0) -> tuple[int, float]:
    """The row farthest from the first row, and its squared distance."""
    found = farthest(points, [row(points, first)])
    return (first, 0.0) if found is None else (found[0], found[2])
