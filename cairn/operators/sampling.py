"""The representative sample: quotas by group size, picks, and the sample's rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class EmptyQuotas(ValueError):
    """Every group's quota is 0, so that no pass would ever pick a row."""


def quotas(sizes: DataFrame, n: int, size: int) -> DataFrame:
    """quota of every group: its share of the sample, in single precision, cut to an integer."""
    share = F.col("nb_members").cast("float") / F.lit(n).cast("float")
    # one float cast a step: a double in between gives other quotas
    return sizes.withColumn("quota", (share.cast("float") * F.lit(size).cast("float")).cast("float").cast("int"))


def picks(quotas_: DataFrame, size: int) -> DataFrame:
    """The first `size` picks: order, group_id, member_idx.

    Passes go over the groups in order; in each, a group with quota q picks members (j + group_id * q) modulo its size
    for j below q. Later passes pick the same members again. Raises EmptyQuotas if every quota is 0.
    """
    rows = quotas_.select("group_id", "nb_members", "quota")
    a_pass = rows.agg(F.sum("quota")).first()[0] or 0
    if not a_pass:
        raise EmptyQuotas(f"no group is large enough for a pick in a sample of {size}")
    before = F.sum("quota").over(W.orderBy("group_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("quota")
    rows = rows.withColumn("before", before).where("quota > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(-(-size // a_pass) - 1))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)))
    order = F.col("pass") * F.lit(a_pass) + F.col("before") + F.col("j")
    place = (F.col("j") + F.col("group_id").cast("long") * F.col("quota")) % F.col("nb_members")
    return rows.select(order.alias("order"), "group_id", place.alias("member_idx")).where(F.col("order") < size)


def sample(picked: DataFrame, members: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Rows of the sample with repeats: sel_idx (chunk, then pick order), row_id, features."""
    rows = picked.join(members, ["group_id", "member_idx"]).select("order", "row_id")
    found = points.join(rows, "row_id").withColumn("chunk", F.floor(F.col("row_id") / size))
    # a sample is a chunk: one task's memory by definition
    return found.select((F.row_number().over(W.orderBy("chunk", "order")) - 1).alias("sel_idx"), "row_id", "features")


def random_rows(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k different rows by a seeded hash of row_id; the same on every run."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")).cast("binary"))
    return points.withColumn("key", key).orderBy("key", "row_id").limit(k).drop("key")
