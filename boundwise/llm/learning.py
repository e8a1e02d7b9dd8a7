"""Labelled samples for the classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what a classifier is fitted on: so many labelled documents of each class, none with more bytes of text than this.
SAMPLE_PER_CLASS, SAMPLE_TEXT_BYTES = 3000, 40_000


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds; a null doc_id is in fold 0."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds).cast("int")


def labelled(documents: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, per_class: int = SAMPLE_PER_CLASS, text_bytes: int = SAMPLE_TEXT_BYTES) -> tuple[pa.Table, dict[int, float]]:
    """A sample (text, label), ordered by a hash of doc_id, from labels outside the held-out fold; and each class's weight, its
    share of all such labels over its share of the sample. Labels other than 0 and 1 are left out."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(f"doc_id is not null and label in (0, 1)")
    known = known.filter(fold("doc_id", folds) != held_out).withColumn("order", F.xxhash64("doc_id"))
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = None
    for label in sorted(total):
        some = known.filter(F.col("label") == label).orderBy("order", "doc_id").limit(per_class)
        pick = some if pick is None else pick.unionByName(some)
    if pick is None:
        return pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())}), {}
    # at most two times per_class small rows
    rows = documents.select("doc_id", "text").filter(F.octet_length("text") <= text_bytes).join(F.broadcast(pick), "doc_id")
    found = rows.orderBy("order", "doc_id", "label", F.xxhash64("text")).limit(2 * per_class).select("text", "label").toArrow()
    sampled = {k: sum(x == k for x in found["label"].to_pylist()) for k in total}
    all_labels, all_sampled = sum(total.values()), max(1, sum(sampled.values()))
    return found, {k: (total[k] / all_labels) / (sampled[k] / all_sampled) for k in total if sampled[k]}
