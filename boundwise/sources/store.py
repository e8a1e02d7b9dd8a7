"""Sketches on disk: an append-only parquet table beside the data, and the session's seed."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .registry import Entry, Registry

_SCHEMA = "key string, saved long, kind string, source string, expression string, params string, seed long, state string, n long, value_type string, sketch binary, values array<string>, counters array<long>, errors array<long>, lost long"


class Store:
    """root/sketches has a row for each time an entry was saved; the last one counts. A write is a Spark job, so it is there
    as a whole or not at all, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.saved = spark, root.rstrip("/"), 0

    def _read(self, name: str, schema: str):
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def save(self, entries: list[Entry]) -> None:
        self.saved = max(self.saved + 1, time.time_ns())
        rows = [(json.dumps(e.key), self.saved, e.kind, e.source, e.expression, json.dumps(e.params), e.seed, e.state, e.n, e.value_type, bytearray(e.sketch), e.values, e.counters, e.errors, e.lost) for e in entries]
        if rows:
            self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/sketches")

    def load(self, registry: Registry) -> None:
        table = self._read("sketches", _SCHEMA)
        if table is None:
            return
        last = table.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("saved")))).filter("nth = 1")
        for r in last.toLocalIterator():
            registry.put(Entry(r.kind, r.source, r.expression, json.loads(r.params), r.seed, r.state, r.n, r.value_type, bytes(r.sketch or b""), list(r.values), list(r.counters), list(r.errors), r.lost))

    def seed(self) -> int | None:
        found = self._read("meta", "seed long")
        row = found.first() if found is not None else None
        return row.seed if row else None

    def save_seed(self, seed: int) -> None:
        self.spark.createDataFrame([(seed,)], "seed long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta")
