"""The multiplicative congruential generator: state * 16807 modulo 2^31 - 1.

The n-th state after a seed is seed * 16807^n, so every row computes its own draw by binary powers, and no row waits
for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generator.
MULTIPLIER, MODULUS, SCALE = 16807, 2147483647, 4.656612875e-10
_BITS = 40


def state(seed: int, n: Column) -> Column:
    """The state after n steps (n >= 0, below 2^40)."""
    if seed % MODULUS == 0:
        raise ValueError("a seed of 0 gives nothing but 0")
    s = F.lit(seed % MODULUS).cast("long")
    for b in range(_BITS):
        power = pow(MULTIPLIER, 1 << b, MODULUS)
        s = s * F.when(F.shiftright(n, b).bitwiseAND(F.lit(1)) == 1, F.lit(power)).otherwise(F.lit(1)) % F.lit(MODULUS)
    return s


def state_sql(seed: int, n: str) -> str:
    """state() as an SQL expression for DuckDB."""
    s = f"{seed % MODULUS}::BIGINT"
    for b in range(_BITS):
        s = f"(({s}) * CASE WHEN ({n})::BIGINT >> {b} & 1 = 1 THEN {pow(MULTIPLIER, 1 << b, MODULUS)} ELSE 1 END % {MODULUS})"
    return s


def uniform(seed: int, n: Column) -> Column:
    """The n-th draw (from 1) in (0, 1)."""
    return state(seed, n) * F.lit(SCALE)


def uniform_vector(seed: int, before: Column, n: int) -> Column:
    """Array of the n draws in (0, 1) that follow the first `before` ones."""
    powers = F.array(*(F.lit(pow(MULTIPLIER, i, MODULUS)).cast("long") for i in range(1, n + 1)))
    return F.element_at(F.transform(F.array(state(seed, before)), lambda s: F.transform(powers, lambda p: s * p % F.lit(MODULUS) * F.lit(SCALE))), 1)


def uniform_matrix(spark: SparkSession, seed: int, m: int, n: int) -> DataFrame:
    """An m by n matrix of draws, filled column by column: i, j, v."""
    k = F.col("id")
    return spark.range(m * n).select((k % m).cast("int").alias("i"), F.floor(k / m).cast("int").alias("j"), uniform(seed, k + 1).alias("v"))


def uniform_int(seed: int, n: Column, a: int, b: int) -> Column:
    """The n-th draw (from 1) of an integer from a to b, scaled in single precision."""
    low, high = min(a, b), max(a, b)
    r = (state(seed, n).cast("float").cast("double") * F.lit(SCALE)).cast("float").cast("double")
    r = ((F.lit(1.0) - r) * F.lit(low - 0.5) + r * F.lit(high + 0.5)).cast("float")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.abs(r) + F.lit(0.5)).cast("int") * F.signum(r).cast("int")))


def uniform_int_sql(seed: int, n: str, a: int, b: int) -> str:
    """uniform_int() as an SQL expression for DuckDB."""
    low, high = min(a, b), max(a, b)
    r = f"({state_sql(seed, n)}::FLOAT::DOUBLE * {SCALE}::DOUBLE)::FLOAT::DOUBLE"
    r = f"((1 - {r}) * ({low} - 0.5::DOUBLE) + {r} * ({high} + 0.5::DOUBLE))::FLOAT"
    return f"greatest({low}, least({high}, (floor(abs({r}) + 0.5) * sign({r}))::INTEGER))"
