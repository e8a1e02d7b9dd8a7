"""Structured Streaming: tables with their sketches kept up to date, and sketches of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import bounds
from ..operators import hll, quantiles
from ..plans.statements import Hint
from ..session import Session


def maintain(session: Session, stream: DataFrame, table: str, checkpoint: str, hint: Hint | None = None, name: str | None = None) -> StreamingQuery:
    """Appends a stream to a table, batch by batch, sketches included; what is there is taken and the query ends. A batch that
    is repeated in this session is left out. Sketches carry the state of the table's files, so after a crash between the
    table's write and the sketches' they are rebuilt rather than wrong."""

    def batch(rows: DataFrame, nth: int) -> None:
        rows = rows.persist()
        session.append_batch(name or checkpoint, nth, rows, table, hint)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, ts: str, value: str, window: str, watermark: str, epsilon: float, confidence: float, slide: str | None = None, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(start, end, by..., n, distinct_sketch, quantile_sketch) of each window; works on batches as well. Late rows beyond the
    watermark are left out of a stream."""
    out = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    precision, k = bounds.hll_precision(epsilon, confidence), bounds.kll_capacity(epsilon, confidence)
    p, k_ = min(precision.value, bounds.NATIVE_HLL_PRECISION), min(k.value, bounds.NATIVE_KLL_K)
    span = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    got = out.groupBy(span.alias("_w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), hll.native(F.col(value), p, seed).alias("distinct_sketch"), quantiles.sketch(F.col(value), k_).alias("quantile_sketch"))
    return got.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *(by or []), "n", "distinct_sketch", "quantile_sketch")


def estimates(windows: DataFrame, *probabilities: float) -> DataFrame:
    """The windows with distinct (estimated count) and a column q<percent> for each probability."""
    def quantile(p: float) -> Column:
        return F.expr(f"if(n = 0, 0D, kll_sketch_get_quantile_double(quantile_sketch, {p}D))").alias(f"q{round(p * 100)}")

    return windows.select(*[c for c in windows.columns if not c.endswith("_sketch")], F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *map(quantile, probabilities))
