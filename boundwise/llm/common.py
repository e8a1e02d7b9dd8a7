"""What the corpus operators share: tables, saved steps, Arrow text buffers, words and rolling hashes."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

#: A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; its arrays take some 60 times as much.
STEP_BYTES = 250_000
#: Rows that Spark hands to Python at once, where the session doesn't say.
BATCH_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="boundwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so that lost executors cost no more than their tasks."""
    path = f"{shared_dir(df.sparkSession)}/boundwise/{name}-{uuid.uuid4().hex}"
    _saved.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that this process has saved and not removed, in order.
_saved: list[str] = []


class Steps:
    """What is saved inside a with block goes at its end, but for the tables that were kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.first, self.kept = spark, 0, set()

    def __enter__(self) -> Steps:
        self.first = len(_saved)
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, saved, and what is left when the block ends."""
        out = save(df, name)
        self.kept.add(_saved[-1])
        return out

    def __exit__(self, *_: object) -> None:
        for path in [p for p in _saved[self.first :] if p not in self.kept]:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this process, wherever Spark has written it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _saved.remove(path)


#: Tables of up to so many rows, each a key and some numbers, are broadcast once they are counted.
BROADCAST_KEYS = 500_000
#: A key that more rows than this have is dealt out over several tasks.
HOT_ROWS = 100_000


def lookup(rows: DataFrame, of: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with of, a saved table of few columns that has each key once. A small one is broadcast. Else both sides shuffle,
    and a key that many rows have is dealt out: its rows by their hash, and its one row of the other side to each part. The keys
    that are dealt out are few enough to broadcast, whatever the rows."""
    if of.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(of), keys, how)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = max(HOT_ROWS, n.agg(F.sum("_n")).first()[0] // BROADCAST_KEYS + 1)
    often = save(n.filter(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_parts")), "often")
    if often.isEmpty():
        return rows.join(of, keys, how)
    often, parts = F.broadcast(often), F.coalesce("_parts", F.lit(1))
    rows = rows.join(often, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    of = of.join(often, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return rows.join(of, [*keys, "_part"], how).drop("_part")


def arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, where f is in this package, over batches that a worker can hold beside others."""
    _small_batches(df.sparkSession)
    return shipping.arrow(df, _released(f), schema)


def _released(f: Callable) -> Callable:
    """f, and behind its last batch what the process has freed goes back to the system: workers stay for later tasks, and what
    they keep adds to the next operator's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        Rolling._powers.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def ship(spark: SparkSession) -> None:
    _small_batches(spark)
    shipping.ship(spark)


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Texts:
    """The texts of a piece of a batch, as bytes end to end: row i holds data[offsets[i]:offsets[i + 1]]. A null is empty."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text"):
        self.batch = batch
        text = batch.column(column)
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        at = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        held = text.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[Texts]:
    """The batches in pieces of about step bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = Texts(batch, column).offsets
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, "right")) - 1)
            yield Texts(batch.slice(first, last - first), column)
            first = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of Texts: starts, ends (byte places), row (of each word), first (the first word of each row, and the end)."""

    def __init__(self, t: Texts, of: np.ndarray | None = None):
        """of: the bytes that words are made of, as 256 flags."""
        n = len(t.data)
        inside = ~_SPACE[t.data] if of is None else of[t.data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            inner = t.offsets[(t.offsets > 0) & (t.offsets < n)]
            begin[inner] = inside[inner]
            end[inner - 1] = inside[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, t.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(t)), self.counts)
        self.place = np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes of all spans of bytes, from one cumulative sum, for features that may share a bucket. Arithmetic is modulo
    2**64, so there are long strings that any base takes for each other: nothing that must be equal is compared by these."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray):
        have = self._powers.get(_BASE)
        if have is None or len(have[0]) <= len(values):
            n = max(1 << 16, 1 << int(len(values)).bit_length())
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            have = np.cumprod(up), np.cumprod(down)
            if n <= 1 << 22:
                self._powers[_BASE] = have
        self.down = have[1]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * have[0][: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


_BASE = 0x9E3779B97F4A7C15
#: A number for each byte.
BYTES = np.random.default_rng(7919).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Strings of up to so many bytes are their own identity.
SHORT = 15
_LOW = (1 << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1)
_MASKS = np.append(_LOW, ~np.uint64(0))
_KEY = b"boundwise strings"


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell strings apart, in two numbers: a short string's bytes and length themselves; else a keyed BLAKE2b digest,
    marked by a length that no short string has."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    n = ends - starts
    low = eight[starts] & _MASKS[np.minimum(n, 8)]
    high = eight[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(n - 8, 0, 7)]
    high |= np.minimum(n, 255).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(n > SHORT)
    if len(long):
        raw = data.tobytes()
        found = [hashlib.blake2b(raw[a:b], digest_size=16, key=_KEY).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        both = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        low[long], high[long] = both[:, 0], both[:, 1] | np.uint64(255 << 56)
    return low, high


_SEEDS = np.random.default_rng(61).integers(1, 2**63, 8, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(t: Texts, w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; those of two seeds are independent."""
    low, high = identities(t.data, w.starts, w.ends)
    return mix(mix(low ^ _SEEDS[seed]) * _ODD + mix(high + _SEEDS[seed]))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n hashes in a row, by place of the first. Runs of powers of two are joined pairwise, and their sums over n
    put together; every join mixes all bits, so that it keeps no structure which a sequence could be made to cancel."""
    out, at, run, size = None, 0, hashes, 1
    while True:
        if n & size:
            out = run if out is None else _joined(out, run, at)
            at += size
        size *= 2
        if size > n:
            return out
        run = _joined(run, run, size // 2)


def _joined(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    m = max(0, min(len(a), len(b) - at))
    return mix(a[:m] * _ODD + mix(b[at : at + m] + _SEEDS[7]))


def runs(first: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The places in the word sequence where n consecutive words of one row start."""
    room = np.maximum(counts - n + 1, 0)
    ends = np.cumsum(room)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - room, room) + np.repeat(first[:-1], room)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
