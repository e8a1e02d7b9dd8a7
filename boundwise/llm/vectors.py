"""What the embedding operators share: valid vectors and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, *others: str) -> DataFrame:
    """vec_id and the others, v (floats or doubles, as given; other numbers as doubles) and ok: whether the vector is usable and has
    an id. Floats stay floats on their way through shuffles; all arithmetic is on doubles."""
    given = F.col("embedding") if df.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), *others, given.alias("v"))
    return out.withColumn("ok", usable("v") & F.col("vec_id").isNotNull())


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
