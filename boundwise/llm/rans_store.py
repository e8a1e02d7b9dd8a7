"""Token ids of documents in a compressed binary store, written and read in parallel.

A store is a folder of two tables. ``model`` has the shared frequency table, counted over all ids. ``segments`` has
segments: each holds some whole documents in ascending doc_id order, as one byte string

    magic, version, documents, ids, place of the first id, block length, blocks, checksum of the frequency table
    doc_ids, numbers of ids by document
    checkpoints: for each block its length in bytes, its number of ids, the checksum of its ids
    the blocks (``rans``)

with little-endian integers. A segment is read alone, any block of it from its checkpoint; a segment ends with the document
that brings it to ``SEGMENT`` ids. The ids of all documents, each with the end id behind it, form one sequence.

Defined results: a null text is empty, it has the end id alone; equal rows are stored each; of rows with one doc_id those
with fewer ids, then smaller id bytes, come first; rows without doc_id come first of all; an empty table gives an empty store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, partitions, save, shared_dir, texts
from .piece_encoder import encoder
from .rans import decode_blocks, encode_blocks, quantised

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
BLOCK, SEGMENT = 1 << 16, 1 << 20
#: Bytes of text at a time: each step looks its pre-tokens up among all that are known.
STEP = 1 << 20
MAGIC, VERSION = b"BWTI", 1
_HEAD = struct.Struct("<4sIQQQIII")
_NO_ID = -(2**63)
#: Quantiles of the numbers of ids under one doc_id.
_GRID = 256


def _tokenised(path: str, end_id: int):
    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = encoder(path), zstandard.ZstdCompressor(level=3)
        for t in texts(batches, step=STEP):
            ids, count = own.encode(t)
            after = np.cumsum(count + 1)
            out = np.full(len(ids) + len(count), end_id, np.uint32)
            put = np.ones(len(out), bool)
            put[after - 1] = False
            out[put] = ids
            packed = [pack.compress(x.astype("<u2" if own.size <= 1 << 16 else "<u4").tobytes()) for x in np.split(out, after[:-1])]
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), pa.array(count + 1, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    return tokenised


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _counted(size: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total += np.bincount(_unpacked(packed, n), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "n"])

    return counted


def pack(doc_ids: list[int | None], ids: list[np.ndarray], place: int, frequencies: bytes, block: int = BLOCK) -> bytes:
    """A segment."""
    every = np.concatenate(ids)
    blocks = encode_blocks(every, frequencies, block)
    head = _HEAD.pack(MAGIC, VERSION, len(ids), len(every), place, block, len(blocks), zlib.crc32(frequencies))
    docs = np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([len(x) for x in ids], "<u8").tobytes()
    return head + docs + b"".join(struct.pack("<III", len(data), n, crc) for data, n, crc in blocks) + b"".join(b[0] for b in blocks)


def unpack(segment: bytes, frequencies: bytes, blocks: range | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """doc_ids, numbers of ids, place of the first id, and the ids; of some blocks only, their ids."""
    magic, version, n_docs, _, place, _, n_blocks, crc = _HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION or crc != zlib.crc32(frequencies):
        raise ValueError("not a segment of this store")
    at = _HEAD.size
    doc_ids, counts = np.frombuffer(segment, "<i8", n_docs, at), np.frombuffer(segment, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    points = np.frombuffer(segment, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    begin = at + 12 * n_blocks + np.concatenate([[0], np.cumsum(points[:, 0], dtype=np.int64)])
    parts = [(segment[begin[i] : begin[i + 1]], int(points[i, 1]), int(points[i, 2])) for i in (blocks if blocks is not None else range(n_blocks))]
    return doc_ids, counts, place, decode_blocks(parts, frequencies)


def _written(frequencies: bytes, bases: list[int], block: int, segment: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition: the documents of its buckets in order."""
        bucket, place, doc_ids, ids, held, nth = None, 0, [], [], 0, 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([nth], pa.int32()), pa.array([place], pa.int64()), pa.array([pack(doc_ids, ids, place, frequencies, block)], pa.binary())], ["bucket", "nth", "place", "segment"])

        for batch in batches:
            for own, doc_id, n, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "ids")), strict=True):
                if own != bucket or held >= segment:
                    if held:
                        yield full()
                        place, nth = place + held, nth + 1
                    if own != bucket:
                        bucket, place, nth = own, bases[own], 0
                    doc_ids, ids, held = [], [], 0
                doc_ids.append(doc_id)
                ids.append(_unpacked(packed, n))
                held += n
        if held:
            yield full()

    return written


def _bounds(tokens: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """Where buckets of about equally many documents end, as (has a doc_id, doc_id, number of ids), in order: at quantiles of the
    doc_ids, and where one doc_id, or none, has several buckets' worth of rows, at quantiles of their numbers of ids. Any bounds
    give the same sequence."""
    every, unknown, found = tokens.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1)), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()
    times = {(True, d): m for d, m in Counter(found or []).items()}
    if every and (m := n * unknown // every):
        times[False, 0] = m
    crowded = [d for (known, d), m in times.items() if known and m > 1]
    some = tokens.filter(F.col("doc_id").isin(crowded) | F.col("doc_id").isNull()) if (False, 0) in times else tokens.filter(F.col("doc_id").isin(crowded))
    grid = [i / _GRID for i in range(1, _GRID)]
    sizes = {}
    if crowded or (False, 0) in times:
        sizes = {(r.doc_id is not None, r.doc_id or 0): r.q for r in some.groupBy("doc_id").agg(F.percentile_approx("n", grid, 20 * _GRID).alias("q")).collect()}  # at most 2n
    out = set()
    for key, m in times.items():
        q = sizes.get(key)
        out |= {(*key, q[j * len(q) // m]) for j in range(m)} if q else {(*key, 2**63 - 1)}
    return sorted(out)


def write(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Encodes every whole text, appends the end id and writes a store."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = save(arrow(docs, _tokenised(tokenizer, end_id), "doc_id long, n long, ids binary"), "tokens")
    size = encoder(tokenizer).size
    counts = np.zeros(size, np.int64)
    for r in arrow(tokens, _counted(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r.id] = r.n
    frequencies = quantised(counts).astype("<u4").tobytes()
    bounds = _bounds(tokens, partitions(spark))
    if bounds:
        # how many bounds are below, by steps of some bounds first: few comparisons a row, however many buckets
        step = max(1, int(len(bounds) ** 0.5))
        kind = "array<struct<known: boolean, doc_id: long, n: long>>"
        edges = spark.createDataFrame([(bounds, bounds[step - 1 :: step])], f"bounds {kind}, steps {kind}")  # one row
        key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("n").alias("n"))
        below = lambda values: F.size(F.filter(values, lambda b: b < key))
        tokens = tokens.crossJoin(F.broadcast(edges)).withColumn("first", below(F.col("steps")) * step)
        bucket = F.col("first") + below(F.slice("bounds", F.col("first") + 1, F.lit(step)))
        tokens = tokens.withColumn("bucket", bucket.cast("int")).drop("bounds", "steps", "first")
    else:
        tokens = tokens.withColumn("bucket", F.lit(0))
    held = {r.bucket: r.n for r in tokens.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    bases = list(accumulate((held.get(j, 0) for j in range(len(bounds))), initial=0))
    ordered = tokens.repartitionById(len(bases), F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "ids")
    out = arrow(ordered, _written(frequencies, bases, block, segment), "bucket int, nth int, place long, segment binary")
    out.write.option("compression", "uncompressed").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(frequencies),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/model")


def _read(frequencies: bytes):
    def read_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                doc_ids, counts, place, ids = unpack(batch.column("segment")[i].as_py(), frequencies)
                after = np.cumsum(counts)
                own = pa.array(doc_ids.astype(np.int64), mask=doc_ids == _NO_ID)
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * (b - n) : 4 * b] for b, n in zip(after.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own, pa.array(place + after - counts), pa.array(counts), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return read_


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (place of its first id in the sequence), n_tokens (with the end id), ids (little-endian unsigned 32-bit)."""
    frequencies = bytes(spark.read.parquet(f"{path}/model").first().frequencies)
    segments = spark.read.parquet(f"{path}/segments").select("segment")
    return arrow(segments, _read(frequencies), "doc_id long, start long, n_tokens long, ids binary")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from a store written in the shared folder and read back."""
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/boundwise/store-{uuid.uuid4().hex}"
    write(documents, path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
