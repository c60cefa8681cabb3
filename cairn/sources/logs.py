"""Logs of a clustering run: phase events, CPU and I/O samples, frequencies, scheduler samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of a log in order.
EVENTS = "AbsoluteTime long, Phase int, Step int, Loop int, Iteration int, Frequency long, CPU_Usage double, RSZ double, SWAP double, Cumul_pflts double, Nb_pflts double, Read_Kbps double, Write_Kbps double"
SCHEDULER = "ts_ms long, util_avg double, load_avg double"
#: Frequency that phase events carry.
FREQUENCY = 2_900_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log with a header; absent fields, and fields given as *, are null."""
    return spark.read.schema(EVENTS).csv(path, header=True, nullValue="*", mode="PERMISSIVE", enforceSchema=True)


def read_scheduler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEDULER).csv(path)


def events(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Phase events (ms, phase, step, loop, iteration) as log rows."""
    return spark.createDataFrame([(*r, FREQUENCY) for r in rows], "AbsoluteTime long, Phase int, Step int, Loop int, Iteration int, Frequency long")


def append(rows: DataFrame, path: str) -> None:
    """Appends log rows to a CSV log."""
    rows.write.mode("append").csv(path, header=True)


def stack(*logs: DataFrame) -> DataFrame:
    """All rows of all logs, missing columns null."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def in_order(log: DataFrame) -> DataFrame:
    return log.orderBy("AbsoluteTime")


def durations(log: DataFrame, run: str) -> DataFrame:
    """The log with ms since the event before in the same run (null for a run's first)."""
    w = W.partitionBy(run).orderBy("AbsoluteTime", "Phase", "Step", "Loop")
    return log.withColumn("duration_ms", F.col("AbsoluteTime") - F.lag("AbsoluteTime").over(w))
