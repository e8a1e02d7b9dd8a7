"""Seeded hashes of a column: a fast one, and a portable one that any engine with MD5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the portable hash.
BITS = 60


def portable(value: Column, seed: int | str = 0) -> Column:
    """60 bits of MD5 over "seed|value"; null stays null. Integers and strings have the same text everywhere."""
    text = F.concat(F.lit(f"{seed}|"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fast(value: Column, seed: int = 0) -> Column:
    """60 bits of xxHash64; null stays null, unlike in xxhash64 itself."""
    return F.when(value.isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), value), 4))


def hashed(value: Column, seed: int, is_portable: bool) -> Column:
    return portable(value, seed) if is_portable else fast(value, seed)
