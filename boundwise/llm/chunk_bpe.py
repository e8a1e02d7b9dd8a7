"""Byte-level BPE over whole texts, in overlapping chunks.

A text of up to ``CHUNK`` characters is encoded in one go. A longer one is cut into chunks that overlap; chunks are
pre-tokenised where they lie, in parallel. The pre-tokens of a chunk may start wrongly, but once a chunk has a boundary
in common with the chunk before it, the rest is the same: the first such boundary inside the overlap is the cut between
the two. Pieces between cuts are encoded in parallel and their ids put end to end. A text whose chunks nowhere meet in an
overlap (one pre-token longer than it, say) is encoded in one go.

A boundary counts only if a character other than white space stands before it, as white space is split by what follows it,
and only if its pre-token does not touch the chunk's end.

Defined results: a null text is empty; equal rows get equal results, each its own; a null doc_id is carried along.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, partitions, save, texts

CHUNK, OVERLAP = 1 << 16, 512
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, low: int, high: int, ends: bool, pattern: str = PATTERN) -> list[int]:
    """Safe boundaries between pre-tokens of text in [low, high); ends: the text ends where the document does."""
    out = []
    for m in regex.compile(pattern).finditer(text):
        at = m.start()
        if at >= high:
            break
        if at >= low and at > 0 and not text[at - 1].isspace() and (ends or m.end() < len(text)):
            out.append(at)
    return out


def cuts(text: str, chunk: int = CHUNK, overlap: int = OVERLAP, pattern: str = PATTERN) -> list[int] | None:
    """Where chunks of one text meet: the pieces' starts, or None if two chunks don't meet."""
    out, tail = [0], None
    for start in range(0, max(1, len(text)), chunk):
        part = text[start : start + chunk + overlap]
        ends = start + chunk + overlap >= len(text)
        if start:
            common = set(tail) & {start + x for x in boundaries(part, 0, overlap, ends, pattern)}
            if not common:
                return None
            out.append(min(common))
        tail = [start + x for x in boundaries(part, chunk, chunk + overlap, ends, pattern)]
    return out


def encode(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text by chunks, pieces and cuts, all in this process."""
    at = cuts(text, chunk, overlap) if len(text) > chunk else None
    if at is None:
        return encoding().encode_ordinary(text)
    return [i for a, b in zip(at, [*at[1:], len(text)], strict=True) for i in encoding().encode_ordinary(text[a:b])]


def decode(ids: list[int]) -> bytes:
    """The ids' bytes, end to end."""
    return encoding().decode_bytes(ids)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids: little-endian unsigned 32-bit integers."""
    for t in texts(batches):
        ids = [np.asarray(encoding().encode_ordinary(t.raw(i).decode()), "<u4") for i in range(len(t))]
        keys = [c for c in t.batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(t.batch.column(c) for c in keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], [*keys, "n_tokens", "ids"])


def _digested(rows: list[np.ndarray]) -> list[pa.Array]:
    """Digests of each row's ids, and of the bytes that they decode to."""
    own, names = encoding(), _names()
    ids = [x.tolist() for x in rows]
    shas = [hashlib.sha256(",".join([names[k] for k in x]).encode()).hexdigest() for x in ids]
    decoded = [hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in ids]
    return [pa.array(shas, pa.string()), pa.array(decoded, pa.string())]


@lru_cache(maxsize=1)
def _names() -> list[str]:
    return [str(i) for i in range(encoding().n_vocab)]


def _encoded_and_digested(with_ids: bool):
    def encoded_and_digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Short texts, in one go."""
        for t in texts(batches):
            ids = [np.asarray(encoding().encode_ordinary(t.raw(i).decode()), "<u4") for i in range(len(t))]
            yield _row_batch(t.batch.column("doc_id"), ids, with_ids)

    return encoded_and_digested


def _only_digested(with_ids: bool):
    def only_digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in texts(batches, "ids"):
            yield _row_batch(t.batch.column("doc_id"), [np.frombuffer(t.raw(i), "<u4") for i in range(len(t))], with_ids)

    return only_digested


def _row_batch(doc_id: pa.Array, ids: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    columns = [doc_id, pa.array([len(x) for x in ids], pa.int64()), *_digested(ids)]
    if with_ids:
        columns.append(pa.array([x.tobytes() for x in ids], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds head and tail: safe boundaries of the chunk in its overlap with the one before and the one after."""
    for t in texts(batches):
        head, tail = [], []
        for i, (k, last) in enumerate(zip(t.batch.column("k").to_pylist(), t.batch.column("last").to_pylist(), strict=True)):
            found = boundaries(t.raw(i).decode(), 0, CHUNK + OVERLAP, last)
            head.append([k * CHUNK + x for x in found if x < OVERLAP])
            tail.append([k * CHUNK + x for x in found if x >= CHUNK])
        yield pa.RecordBatch.from_arrays([*t.batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], [*t.batch.schema.names, "head", "tail"])


def _long(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids) of the long texts. row, a number of its own, keeps equal rows apart."""
    docs = save(documents.withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.char_length("text")), "long")
    spark = docs.sparkSession
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK).cast("int") - 1))
    chunks = docs.withColumn("k", k).withColumn("text", F.substring(F.col("text"), F.col("k") * CHUNK + 1, F.lit(CHUNK + OVERLAP)))
    chunks = chunks.withColumn("last", F.col("k") * CHUNK + CHUNK + OVERLAP >= F.col("n")).repartition(partitions(spark), "row", "k")
    chunks = save(arrow(chunks, _edges, "doc_id long, text string, row long, n int, k int, last boolean, head array<long>, tail array<long>"), "chunks")
    of_row = Window.partitionBy("row").orderBy("k")
    at = chunks.select("row", "n", "k", F.array_min(F.array_intersect("head", F.lag("tail").over(of_row))).alias("cut"))
    at = at.withColumn("cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("cut")))
    at = at.withColumn("upto", F.coalesce(F.lead("cut").over(of_row), F.when(F.lead("k").over(of_row).isNull(), F.col("n"))))
    at = save(at.withColumn("met", F.min(F.col("cut").isNotNull() & F.col("upto").isNotNull()).over(Window.partitionBy("row"))), "cuts")
    pieces = chunks.select("doc_id", "row", "k", "text").join(at.filter("met").select("row", "k", "cut", "upto"), ["row", "k"])
    pieces = pieces.select("doc_id", "row", "k", F.substring(F.col("text"), (F.col("cut") - F.col("k") * CHUNK + 1).cast("int"), (F.col("upto") - F.col("cut")).cast("int")).alias("text"))
    whole = docs.join(at.filter("not met and k = 0").select("row"), "row").select("doc_id", "row", F.lit(0).alias("k"), "text")
    ids = arrow(pieces.unionByName(whole), _encoded, "doc_id long, row long, k int, n_tokens long, ids binary")
    parts = F.array_sort(F.collect_list(F.struct("k", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit("").cast("binary"), lambda have, x: F.concat(have, x["ids"]))
    return ids.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), parts.alias("parts")).select("doc_id", "n_tokens", joined.alias("ids"))


def encoded(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > CHUNK
    return arrow(docs.filter(~long), _encoded, "doc_id long, n_tokens long, ids binary").unionByName(_long(docs.filter(long)))


def digests(documents: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again from the ids; and, if asked for, ids."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > CHUNK
    short = arrow(docs.filter(~long), _encoded_and_digested(with_ids), schema)
    return short.unionByName(arrow(_long(docs.filter(long)), _only_digested(with_ids), schema))
