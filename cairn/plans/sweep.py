"""Parameter sweeps and the memory that a run needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def memory_mb(chunk: Column, dim: int, k: int) -> Column:
    """Megabytes for a chunk of points: points and centers as doubles, three int arrays, rounded up, and a margin."""
    size = chunk * F.lit(dim * 8) + chunk * F.lit(k * 8) + chunk * F.lit(2 * 4) + chunk * F.lit(4)
    return (F.ceil(size / F.lit(float(1 << 20)) + F.lit(1.5)) + 1).cast("long")


def sweep(spark: SparkSession, n: int, dim: int, k: int, ratios: Sequence[int], settings: Sequence[str]) -> DataFrame:
    """Every memory ratio with every setting (a governor, a frequency): ratio, chunk, memory_mb, setting, tag."""
    each = [(r, s) for r in ratios for s in settings]
    rows = spark.createDataFrame(each, "ratio int, setting string")
    rows = rows.withColumn("chunk", F.floor(F.lit(n) / F.col("ratio")).cast("long"))
    tag = F.concat_ws(",", F.lit(str(n)), F.col("chunk").cast("string"), F.col("ratio").cast("string"), F.col("setting"))
    return rows.select("ratio", "chunk", memory_mb(F.col("chunk"), dim, k).alias("memory_mb"), "setting", tag.alias("tag"))
