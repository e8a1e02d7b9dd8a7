"""HyperLogLog: as a table of registers (any precision from 4 to 24, seeded, mergeable, repeatable elsewhere), and natively."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BITS, hashed


def registers(df: DataFrame, value: Column, precision: int, by: list[str] | None = None, seed: int = 0, portable: bool = False) -> DataFrame:
    """(by..., idx, rho): of each register that has a value, the largest rank. Partial aggregation leaves at most 2**precision
    rows of a group and task to shuffle. Nulls don't count."""
    rest_bits = BITS - precision
    h = hashed(value, seed, portable)
    rows = df.select(*(by or []), h.alias("_h")).filter("_h is not null")
    rest = F.col("_h").bitwiseAND((1 << rest_bits) - 1)
    rho = F.when(rest == 0, rest_bits + 1).otherwise(rest_bits - F.length(F.bin(rest)) + 1).cast("int")
    return rows.groupBy(*(by or []), F.shiftright("_h", rest_bits).cast("int").alias("idx")).agg(F.max(rho).alias("rho"))


def merged(registers_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The registers of the union: the largest rank of each."""
    return registers_.groupBy(*(by or []), "idx").agg(F.max("rho").alias("rho"))


def alpha(m: int) -> float:
    """Bias correction of the raw estimate. Fixed values."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def estimate(registers_: DataFrame, precision: int, by: list[str] | None = None, name: str = "estimate") -> DataFrame:
    """(by..., estimate): the raw estimate, or linear counting where it is small and registers are empty. No rows: 0.0, if not grouped."""
    m = float(1 << precision)
    filled, powers = F.count(F.lit(1)), F.sum(F.pow(F.lit(2.0), -F.col("rho")))
    empty = F.lit(m) - F.col("_filled")
    raw = F.lit(alpha(int(m)) * m * m) / (F.coalesce("_powers", F.lit(0.0)) + empty)
    small = (raw <= 2.5 * m) & (empty > 0)
    out = registers_.groupBy(*(by or [])).agg(filled.cast("double").alias("_filled"), powers.alias("_powers"))
    return out.select(*(by or []), F.when(F.col("_filled") == 0, 0.0).when(small, m * F.log(F.lit(m) / empty)).otherwise(raw).alias(name))


def native(value: Column, precision: int, seed: int = 0) -> Column:
    """The bytes of a native sketch. Hashing first lets any type in and counts empty strings."""
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(F.lit(seed).cast("long"), value)), precision)


def relative_error(precision: int) -> float:
    return 1.04 / math.sqrt(1 << precision)
