"""Quantiles: native KLL sketches, the deterministic summary of percentile_approx, and the exact rank rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The quartile functions. Fixed values.
QUARTILES = {"approx_25": 0.25, "approx_median": 0.5, "approx_75": 0.75}


#: Ranges of values in which an exact rank is counted.
RANGES = 128


def finite(value: Column) -> Column:
    """As a finite double, else null."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def sketch(value: Column, k: int) -> Column:
    return F.kll_sketch_agg_double(finite(value), F.lit(k))


def exact_rank(df: DataFrame, value: Column, probabilities: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by..., name of each probability): the value at index ceil(p (n - 1)) of the sorted finite values, which a sketch
    that holds all values gives; 0.0 without any, if not grouped. Works on value counts, so equal values shuffle once. Without
    groups, running counts are taken inside ``RANGES`` ranges of values, so that no task has them all; a group is one task's."""
    by = by or []
    counts = df.select(*by, finite(value).alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if by:
        group = Window.partitionBy(*by)
        counts = counts.withColumn("_upto", F.sum("_c").over(group.orderBy("_v"))).withColumn("_n", F.sum("_c").over(group))
    else:
        bounds = counts.agg(F.coalesce(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 20 * RANGES), F.array().cast("array<double>")).alias("_bounds"))
        counts = counts.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")  # one row
        everything = Window.partitionBy()
        sums = counts.groupBy("_range").agg(F.sum("_c").alias("_in"))  # at most RANGES rows
        sums = sums.select("_range", (F.sum("_in").over(everything.orderBy("_range")) - F.col("_in")).alias("_before"), F.sum("_in").over(everything).alias("_n"))
        inside = F.sum("_c").over(Window.partitionBy("_range").orderBy("_v"))
        counts = counts.join(F.broadcast(sums), "_range").withColumn("_upto", F.col("_before") + inside)
    picked = [F.min(F.when(F.col("_upto") > F.ceil(p * (F.col("_n") - 1)), F.col("_v"))).alias(name) for name, p in probabilities.items()]
    out = counts.groupBy(*by).agg(*picked)
    return out if by else out.select(*[F.coalesce(name, F.lit(0.0)).alias(name) for name in probabilities])
