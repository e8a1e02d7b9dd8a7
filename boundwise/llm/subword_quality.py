"""Quality classifier: supervised subword embeddings.

A document's features are its words, the character n-grams inside them, hashed into tables of learned vectors, and for each
word how many words back it was last (1 to ``LAGS``, or none): no subword, but stammering texts of good words are only told by it
(README: with and without). The document is the average of its features' vectors, each kind
averaged first, so that many n-grams don't drown few words; a softmax over two classes reads it. Training is stochastic gradient
descent in numpy on a bounded sample (``learning``). As the softmax of two classes only needs the difference of the
classes' scores, which is linear in the average, a fitted model is one number for each bucket.

Defined results: a null or empty text has no features and gets the score of the bias alone; without labels of both classes
the score is the share of label 1 among the labels, 0.5 without any; equal rows get equal scores; a null doc_id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, Rolling, Texts, Words, arrow, texts
from .learning import fold, labelled

NGRAMS = (2, 3, 4)
LAGS = 4
KINDS = 2 + len(NGRAMS)
BITS, DIMENSIONS = 16, 8
#: A small sample is gone through more often, for so many steps.
EPOCHS, RATE, LEAST_STEPS = 6, 8.0, 6000
FOLDS, HELD_OUT = 3, 1
SEED = 3


def features(t: Texts, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets of features as (bucket, first of each row): words, then n-grams of each length."""
    w = Words(t)
    bytes_ = Rolling(BYTES[t.data])
    shift = np.uint64(64 - bits)
    words = bytes_.spans(w.starts, w.ends)
    yield (words >> shift).astype(np.int64), w.first
    back = np.zeros(len(words), np.int64)
    for lag in range(LAGS, 0, -1):
        back[lag:][(words[lag:] == words[:-lag]) & (w.place[lag:] >= lag)] = lag
    yield back + (2 << bits), w.first
    begins = (t.data & 0xC0) != 0x80
    chars = np.flatnonzero(begins)
    upto = np.append(np.cumsum(begins) - begins, len(chars))  # characters before each byte
    first, last = upto[w.starts], upto[w.ends]
    ends = np.append(chars, len(t.data))
    for n in NGRAMS:
        room = np.maximum(last - first - n + 1, 0)
        after = np.cumsum(room)
        at = np.arange(after[-1] if len(after) else 0) + np.repeat(first - (after - room), room)
        h = bytes_.spans(ends[at], ends[at + n]) + np.uint64(n)
        yield (h >> shift).astype(np.int64) + (1 << bits), np.concatenate([[0], after])[w.first]


@dataclass
class Model:
    """A document's log-odds of label 1: bias + the average of its buckets' weights."""

    weights: np.ndarray
    bias: float

    def scores(self, t: Texts) -> np.ndarray:
        total = np.zeros(len(t))
        for buckets, first in features(t):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
            total += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / KINDS, -500, 500)))


def fit(sample: pa.Table, weights: dict[int, float], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    size = (2 << BITS) + LAGS + 1
    if len(weights) < 2:
        one = 0.5 if not weights else 0.999 if 1 in weights else 0.001
        return Model(np.zeros(size), float(np.log(one / (1 - one))))
    buckets_of, shares_of, counts = [], [], []
    for t in texts(iter(sample.to_batches())):
        sets, own = list(features(t)), []
        for i in range(len(t)):
            found = [np.unique(b[f[i] : f[i + 1]], return_counts=True) for b, f in sets]
            own.append((np.concatenate([b for b, _ in found]).astype(np.int32), np.concatenate([n / max(1, n.sum()) for _, n in found]).astype(np.float32) / KINDS))
        buckets_of.append(np.concatenate([b for b, _ in own]))
        shares_of.append(np.concatenate([x for _, x in own]))
        counts += [len(b) for b, _ in own]
    # two large arrays rather than many small ones, so that their memory goes back
    all_buckets, all_shares = np.concatenate(buckets_of), np.concatenate(shares_of)
    del buckets_of, shares_of
    at = np.concatenate([[0], np.cumsum(counts)])
    y = np.array(sample["label"].to_pylist())
    weight = np.array([weights[k] for k in y])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.array([np.log(1e-9 + weight[y == k].sum() / weight.sum()) for k in (0, 1)], np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // len(counts)))
    steps, step = epochs * len(counts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(counts)):
            buckets, share = all_buckets[at[i] : at[i + 1]], all_shares[at[i] : at[i + 1]]
            lr = rate * (1 - step / steps) * min(2.0, weight[i])
            step += 1
            mean = share @ vectors[buckets]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= lr * 0.1 * np.outer(p, mean)
            bias -= lr * 0.01 * p
            vectors[buckets] -= lr * share[:, None] * back
    return Model(np.asarray(vectors @ (out[1] - out[0]), np.float64), float(bias[1] - bias[0]))


def train(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    return fit(*labelled(documents, labels, "quality", folds, held_out))


def _score(model: Model, kept: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in texts(batches):
            yield pa.RecordBatch.from_arrays([*(t.batch.column(c) for c in kept), pa.array(model.scores(t), pa.float64())], [*kept, "score"])

    return score


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = arrow(docs, _score(model, ["doc_id"]), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't predicted to be of label 0; the other columns ride along untouched."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in texts(batches):
            yield t.batch.filter(pa.array(model.scores(t) >= 0.5))

    return arrow(documents, keep, documents.schema)
