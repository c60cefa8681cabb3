"""Point sets: (row_id long, features array<double>), from tables or tab-separated text, and their text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions import text

#: Point sets of the test tables: table, column of row ids, columns of features (one array column, or scalars).
NAMED = {
    "events2d": ("events", "event_id", ("value", "user_id")),
    "embed64": ("embeddings", "vec_id", ("embedding",)),
    "customer2d": ("customer", "c_custkey", ("c_acctbal", "c_nationkey")),
}


def from_table(table: DataFrame, row_id: str, features: Sequence[str]) -> DataFrame:
    """Points from columns; row ids must be contiguous from 0, as chunk borders are counted in them."""
    array = len(features) == 1 and table.schema[features[0]].dataType.typeName() == "array"
    made = F.col(features[0]).cast("array<double>") if array else F.array(*(F.col(c).cast("double") for c in features))
    return table.select(F.col(row_id).cast("long").alias("row_id"), made.alias("features"))


def named(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, row_id, features = NAMED[name]
    return from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), row_id, features)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with contiguous row ids in file order.

    A split's lines are contiguous in a task, so a line's id is the number of lines in all splits before, from one
    count a split, plus its place in its own; lines themselves are not shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    splits = splits.select("file", "start", "first", before.alias("before"))
    return lines.join(splits, ["file", "start"]).select((F.col("before") + F.col("place") - F.col("first")).alias("row_id"), "value")


def from_text(spark: SparkSession, path: str, sep: str = "\t", skip: bool = False) -> DataFrame:
    """Points of separated text, one a line; a bad number counts by its prefix, or 0; an empty last field is dropped.

    With skip, blank lines and lines that start with # are no points.
    """
    lines = numbered_lines(spark, path) if not skip else _renumbered(numbered_lines(spark, path).where(kept(F.col("value"))))
    fields = F.split(F.rtrim(F.col("value"), F.lit(sep + "\r\n ")), sep)
    return lines.select("row_id", F.transform(fields, text.prefix_real).alias("features"))


def _renumbered(lines: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    lines = lines.withColumn("chunk", F.floor(F.col("row_id") / chunk))
    sums = lines.groupBy("chunk").agg(F.count("*").alias("n"))
    sums = sums.select("chunk", (F.sum("n").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("chunk").orderBy("row_id")) - 1
    return lines.withColumn("place", place).join(sums, "chunk").select((F.col("before") + F.col("place")).cast("long").alias("row_id"), "value")


def kept(line: Column) -> Column:
    """Lines that count: neither blank nor a # comment."""
    return (F.trim(line, F.lit(" \t\r\n")) != "") & ~line.startswith("#")


def row_count(lines: DataFrame) -> DataFrame:
    """Number of kept lines of (value)."""
    return lines.where(kept(F.col("value"))).agg(F.count("*").alias("n_rows"))


def column_count(lines: DataFrame, separators: str = " \n") -> DataFrame:
    """Words in the first kept line by row_id, else in the first comment line; -1 without lines."""
    comment = ~kept(F.col("value")) & F.col("value").startswith("#")
    ranked = lines.where(kept(F.col("value")) | comment).select(F.struct(comment.alias("comment"), "row_id", text.word_count(F.col("value"), separators).alias("n")).alias("line"))
    return ranked.agg(F.coalesce(F.min("line")["n"], F.lit(-1)).alias("n_columns"))


def header(lines: DataFrame, separators: str = " \n") -> DataFrame:
    """n_columns and n_rows of a matrix file's lines."""
    return column_count(lines, separators).join(row_count(lines))


def chunked(points: DataFrame, size: int) -> DataFrame:
    """Points with chunk_id and local_idx; chunks are row ranges, whatever the partitions."""
    return points.withColumn("chunk_id", F.floor(F.col("row_id") / size)).withColumn("local_idx", F.col("row_id") % size)


def marks(points: DataFrame, size: int) -> DataFrame:
    """First and last row and number of rows of every chunk."""
    by = chunked(points, size).groupBy("chunk_id")
    return by.agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n_rows"))


def rows_between(points: DataFrame, offset: int, length: int) -> DataFrame:
    """A contiguous slice of rows."""
    return points.where((F.col("row_id") >= offset) & (F.col("row_id") < offset + length))


def bounds(points: DataFrame, dim: int) -> DataFrame:
    """Least and largest value of each dimension: dim, lo, hi. One pass, map-side combined."""
    f = lambda i: F.get("features", F.lit(i))
    one = points.agg(*(x for i in range(dim) for x in (F.min(f(i)).alias(f"lo{i}"), F.max(f(i)).alias(f"hi{i}"))))
    each = F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(dim)))
    return one.select(F.explode(each).alias("d")).select("d.*")


def as_text(rows: DataFrame, features: str = "features", trailing: bool = True) -> DataFrame:
    """Rows as lines of tab-separated numbers of 16 decimals, by default with a tab behind the last."""
    line = F.concat_ws("\t", F.transform(features, lambda v: F.format_string("%2.16f", v)))
    return rows.select(F.concat(line, F.lit("\t" if trailing else "")).alias("value"))


def write_text(rows: DataFrame, path: str, order: str, mode: str = "append", trailing: bool = True) -> None:
    """Writes vectors as text lines, in order over the files' names."""
    ordered = rows.orderBy(order)
    as_text(ordered, trailing=trailing).write.mode(mode).text(path)


def ints_as_text(rows: DataFrame, column: str) -> DataFrame:
    """Integers as lines, two blanks before each."""
    return rows.select(F.concat(F.lit("  "), F.col(column).cast("string")).alias("value"))


def log_error(spark: SparkSession, path: str, points: int, clusters: int, iterations: int, error: float) -> None:
    """Appends a row to the error log."""
    spark.createDataFrame([(points, clusters, iterations, error)], "points int, clusters int, iterations int, error double").coalesce(1).write.mode("append").csv(path)
