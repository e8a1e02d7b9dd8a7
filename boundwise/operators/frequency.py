"""Count-Min sketches and heavy hitters as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed
from ..shipping import arrow


def cells(df: DataFrame, value: Column, width: int, depth: int, by: list[str] | None = None, seed: int = 0, portable: bool = False) -> DataFrame:
    """(by..., row, bucket, c): the non-zero cells. Each value becomes depth rows that are counted where they are: a task shuffles at
    most width * depth rows of a group, however many different values it has."""
    by = by or []
    buckets = F.array(*[F.pmod(hashed(F.col("_v"), seed + r, portable), F.lit(width)) for r in range(depth)])
    rows = df.select(*by, value.alias("_v")).filter("_v is not null").select(*by, F.posexplode(buckets).alias("row", "bucket"))
    return rows.groupBy(*by, "row", "bucket").agg(F.count(F.lit(1)).alias("c"))


def merged_cells(cells_: DataFrame, by: list[str] | None = None) -> DataFrame:
    return cells_.groupBy(*(by or []), "row", "bucket").agg(F.sum("c").alias("c"))


def estimates(cells_: DataFrame, targets: DataFrame, target: str, width: int, depth: int, seed: int = 0, portable: bool = False, name: str = "estimate") -> DataFrame:
    """Each target (a column of targets) with the least of its cells; a cell that is missing holds 0. Never below the true count."""
    probes = targets.withColumn("_b", F.array(*[F.pmod(hashed(F.col(target), seed + r, portable), F.lit(width)) for r in range(depth)]))
    probes = probes.select(*targets.columns, F.posexplode("_b").alias("row", "bucket"))
    found = probes.join(cells_.select("row", "bucket", "c"), ["row", "bucket"], "left")
    return found.groupBy(*targets.columns).agg(F.min(F.coalesce("c", F.lit(0).cast("long"))).alias(name))


def join_size(a: DataFrame, b: DataFrame, name: str = "estimate") -> DataFrame:
    """One row: the estimated number of pairs with equal values of two columns, from their cells of one width, depth and seed: the least
    of the rows' inner products. Never below the true number."""
    both = a.select("row", "bucket", F.col("c").alias("ca")).join(b.select("row", "bucket", F.col("c").alias("cb")), ["row", "bucket"], "left")
    sums = both.groupBy("row").agg(F.sum(F.col("ca") * F.coalesce("cb", F.lit(0).cast("long"))).alias("s"))
    return sums.agg(F.coalesce(F.min("s"), F.lit(0).cast("long")).alias(name))


class Summary:
    """Counters of at most capacity values. lost: how much any value can have beyond its counter; what a value can have had
    before it got its counter is its error."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.counters: dict = {}
        self.errors: dict = {}

    def add(self, counts: dict) -> None:
        for value, n in counts.items():
            if value in self.counters:
                self.counters[value] += n
            else:
                self.counters[value], self.errors[value] = n, self.lost
        if len(self.counters) > self.capacity:
            ranked = sorted(self.counters.items(), key=lambda x: (-x[1], x[0]))
            cut = ranked[self.capacity][1]
            self.lost += cut
            self.counters = {v: n - cut for v, n in ranked[: self.capacity]}
            self.errors = {v: self.errors[v] for v in self.counters}

    def merge(self, other: Summary) -> None:
        """Counters add up; a value that one side lacks may have had there all that the side lost."""
        errors = {v: self.errors.get(v, self.lost) + other.errors.get(v, other.lost) for v in [*self.counters, *other.counters]}
        lost = self.lost + other.lost
        counters = {v: self.counters.get(v, 0) + other.counters.get(v, 0) for v in errors}
        self.counters, self.errors, self.lost = counters, errors, lost
        self.add({})

    def top(self, k: int) -> list[tuple]:
        rows = [(v, n + self.lost, self.errors[v]) for v, n in self.counters.items()]
        return sorted(rows, key=lambda r: (-r[1], r[0]))[:k]


def _summaries(capacity: int):
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, kind = Summary(capacity), pa.null()
        for batch in batches:
            column = batch.column(0).drop_null()
            kind = column.type
            found = pc.value_counts(column)
            s.add(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        values = list(s.counters)
        if values:
            counters, errors = [s.counters[v] for v in values], [s.errors[v] - s.lost for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(values, kind), pa.array(counters, pa.int64()), pa.array(errors, pa.int64()), pa.array([0] * len(values), pa.int64())], ["value", "counter", "off", "lost"])
        if s.lost:
            yield pa.RecordBatch.from_arrays([pa.array([None], kind), *(pa.array([n], pa.int64()) for n in (0, 0, s.lost))], ["value", "counter", "off", "lost"])

    return summaries


def summary(df: DataFrame, value: Column, capacity: int) -> DataFrame:
    """(value, counter, off, lost): the merged summary of all partitions, each of capacity counters; the row with a null value
    has what was lost in all. Estimates are counter + lost, errors off + lost."""
    rows = df.select(value.alias("value"))
    kind = rows.schema["value"].dataType.simpleString()
    parts = arrow(rows, _summaries(capacity), f"value {kind}, counter long, off long, lost long")
    return parts.groupBy("value").agg(F.sum("counter").alias("counter"), F.sum("off").alias("off"), F.sum("lost").alias("lost"))


def _sketches(width: int, depth: int, capacity: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, table = Summary(capacity), np.zeros((depth, width), np.int64)
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            s.add(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
            for r in range(depth):
                at, n = np.unique(batch.column(1 + r).to_numpy(), return_counts=True)
                table[r, at] += n
        row, bucket = np.nonzero(table)
        none = pa.nulls(len(row), pa.string())
        zero = pa.array(np.zeros(len(row), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(bucket, pa.int32()), none, pa.array(table[row, bucket]), zero, zero], _SKETCHES)
        rows = [(v, n, s.errors[v] - s.lost, 0) for v, n in s.counters.items()] + ([(None, 0, 0, s.lost)] if s.lost else [])
        if rows:
            no = pa.nulls(len(rows), pa.int32())
            value, *numbers = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([no, no, pa.array(value, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], _SKETCHES)

    return sketches


_SKETCHES = ["row", "bucket", "value", "counter", "off", "lost"]


def sketched(df: DataFrame, value: Column, width: int, depth: int, capacity: int, seed: int = 0) -> DataFrame:
    """Cells and summary of a column's texts from one pass: rows with nth (the cell's row) and bucket are the non-zero cells, their
    count in counter, the others are those of ``summary``. nth is an aggregate, so that no filter on it gets below the pass."""
    rows = df.select(value.cast("string").alias("v")).filter("v is not null")
    buckets = [F.pmod(hashed(F.col("v"), seed + r, False), F.lit(width)).cast("int").alias(f"b{r}") for r in range(depth)]
    parts = arrow(rows.select("v", *buckets), _sketches(width, depth, capacity), "row int, bucket int, value string, counter long, off long, lost long")
    return parts.groupBy("row", "bucket", "value").agg(F.max("row").alias("nth"), *(F.sum(c).alias(c) for c in ("counter", "off", "lost"))).drop("row")


def top_k(summary_: DataFrame, k: int) -> DataFrame:
    """(value, estimate, error), highest estimates first, then by value. estimate - error <= true count <= estimate."""
    lost = summary_.filter("value is null").agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("all_lost"))
    best = summary_.filter("value is not null").orderBy(F.desc("counter"), "value").limit(k)  # lost is the same for all
    best = best.crossJoin(F.broadcast(lost))  # one row
    return best.select("value", (F.col("counter") + F.col("all_lost")).alias("estimate"), (F.col("off") + F.col("all_lost")).alias("error")).orderBy(F.desc("estimate"), "value")
