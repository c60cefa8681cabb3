"""Vectors as array<double> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many terms a distance is written out, so that it stays inside generated code.
_WRITTEN_OUT = 64


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def sq_distance(a: Column, b: Column | Sequence[float], dim: int | None = None) -> Column:
    """Squared Euclidean distance of two vectors, or of a vector and a constant one."""
    if isinstance(b, Column):
        if dim is None or dim > _WRITTEN_OUT:
            return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
        terms = [(F.get(a, i) - F.get(b, i)) for i in map(F.lit, range(dim))]
    elif len(b) > _WRITTEN_OUT:
        return _sum(F.zip_with(a, vector(b), lambda x, y: (x - y) * (x - y)))
    else:
        terms = [F.get(a, F.lit(i)) - F.lit(float(v)) for i, v in enumerate(b)]
    out = terms[0] * terms[0]
    for t in terms[1:]:
        out = out + t * t
    return out


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(v)) for v in values))


def constant(n: int, value: float | int) -> Column:
    """n times the same value: zeros, minus ones."""
    return F.array_repeat(F.lit(value), n)


def total(a: Column) -> Column:
    """Sum of the components; 0 for none."""
    return _sum(a)


def min_index(a: Column) -> Column:
    """Place of the first least component from 0; -1 for an empty vector."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)).cast("int") - 1).otherwise(-1)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the second vector may hold integers."""
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def all_nonpositive(a: Column) -> Column:
    return F.forall(a, lambda v: v <= 0)


def any_negative(a: Column) -> Column:
    return F.exists(a, lambda v: v < 0)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices given as (i, j, v) rows; cells without a row are 0."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("n"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("n").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
