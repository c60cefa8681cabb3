"""Helpers that the training-data operators share: words, lineage cuts, sized joins, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only if a count has shown at most so many rows of a few dozen bytes each.
BROADCAST_ROWS = 200_000

#: Rows of an Arrow batch between the JVM and Python: texts are long, and both sides hold whole batches.
BATCH_ROWS = 1000

#: Shares into which a hot key's rows are dealt when the other side is too large to broadcast.
SALTS = 32


def words(text: Column) -> Column:
    """Array of the words of a text; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row (a lambda variable is not recomputed)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounded_batches(spark: SparkSession) -> None:
    """Has the session send Arrow batches of at most BATCH_ROWS rows (it is read when a query runs, so it stays set)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def wrapped(df: DataFrame) -> DataFrame:
    """The rows as one struct column, `row`, so that no column of theirs can clash with others; row.* gives them back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with line marks before it, such that df has no column of this name in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def tidy(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns beyond them cannot clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def join_sized(left: DataFrame, right: DataFrame, on: str, how: str = "left", limit: int = BROADCAST_ROWS, salt: str | None = None) -> DataFrame:
    """Joins right, which has one row a key and is cheap to count (cut), to left.

    Up to `limit` rows, right is broadcast. Beyond, the join shuffles; with `salt`, a column of left whose hash
    deals a hot key's rows to SALTS shares, against SALTS copies of right's rows. Null keys match null keys.
    """
    other = right.withColumnRenamed(on, "__key")
    if right.count() <= limit:
        return left.join(F.broadcast(other), left[on].eqNullSafe(other["__key"]), how).drop("__key")
    if salt is None:
        return left.join(other, left[on].eqNullSafe(other["__key"]), how).drop("__key")
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt)), F.lit(SALTS)).cast("int"))
    copies = other.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, dealt[on].eqNullSafe(copies["__key"]) & (dealt["__salt"] == copies["__share"]), how).drop("__key", "__salt", "__share")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component_id) a node, its component's smallest node.

    Alternates large-star and small-star steps until the edges are stars round the smallest nodes. Every step is an
    aggregation with map-side combine and an equi join that AQE may split; nothing is collected but one row of totals.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    leaves = e.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return leaves.union(roots)
