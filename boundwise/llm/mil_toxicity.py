"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's log-odds are a bias plus the sum of the weights of its distinct words and of their first ``STEMS`` characters,
so that inflected forms share what their stem tells (hashed; words are runs of letters, ASCII ones lower-cased). A document is toxic if any sentence is: the noisy-or 1 - prod(1 - p). Training is stochastic gradient descent
on the documents' likelihood, so that the blame inside a toxic document goes to the sentences that explain it; the sentence
scores then locate the offending ones. Words that fewer than ``LEAST_DOCS`` documents of
the sample have, or whose shares in the classes differ by less than ``TELLS`` standard errors, weigh nothing.

Sentences end at line ends and behind ``.``, ``!`` or ``?``.

Defined results: a null or empty text has no sentences and scores 0; without labels of both classes the score is 1 if all
labels are 1 and the text has a sentence, else 0; equal rows get equal scores; a null doc_id is carried.
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

BITS = 20
STEMS = (3, 4, 5, 6)
EPOCHS, RATE, LEAST_STEPS = 8, 1.0, 6000
LEAST_DOCS, TELLS = 4, 2.5
SHRINK = 1e-3
FOLDS, HELD_OUT = 5, 0
SEED = 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_END = np.zeros(256, np.int64)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = 1


@dataclass
class Sentences:
    """buckets: of words and stems; sentence: which sentence each is in, counted over all rows; row: of each sentence; start, end: its first and last word's bytes."""

    buckets: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(t: Texts) -> Sentences:
    w = Words(t, _LETTER)
    rolling = Rolling(BYTES[_LOWER[t.data]])
    hashes = rolling.spans(w.starts, w.ends)
    ends = np.concatenate([[0], np.cumsum(_END[t.data])])
    new = np.ones(len(hashes), bool)
    new[1:] = (ends[w.starts[1:]] != ends[w.starts[:-1]]) | (w.row[1:] != w.row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hashes)) - 1 if len(first) else first
    sentence = np.cumsum(new) - 1
    begins = (t.data & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(begins), len(t.data))
    at = (np.cumsum(begins) - begins)[w.starts]
    buckets, of = [hashes], [sentence]
    for n in STEMS:
        stem = chars[np.minimum(at + n, len(chars) - 1)]
        some = np.flatnonzero(stem < w.ends)
        buckets.append(rolling.spans(w.starts[some], stem[some]) + np.uint64(n))
        of.append(sentence[some])
    return Sentences((np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of), w.row[first], w.starts[first], w.ends[last])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        return _sigmoid(self.bias + _sums(self.weights[s.buckets], s.buckets, s.sentence, len(s.row)))

    def scores(self, t: Texts) -> np.ndarray:
        return self.judged(t)[0]

    def judged(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score of each text, how many sentences offend by themselves, and which one does most (from 0; -1: there is none)."""
        s = sentences(t)
        own = self.sentence_scores(s)
        offends = own >= 0.5
        order = np.lexsort((np.arange(len(own)), -own, s.row))
        first = np.searchsorted(s.row, np.arange(len(t)))  # rows of sentences ascend
        worst, some = np.full(len(t), -1), np.flatnonzero(np.diff(np.append(first, len(own))) > 0)
        worst[some] = order[first[some]] - first[some]
        scores = 1 - np.exp(np.bincount(s.row, np.log1p(-np.minimum(own, 1 - 1e-12)), len(t)))
        return scores, np.bincount(s.row, offends, len(t)).astype(np.int64), worst


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(values: np.ndarray, buckets: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Sums by sentence; a bucket counts once in a sentence. Only words with a weight are looked at."""
    some = np.flatnonzero(values)
    if not len(some):
        return np.zeros(n)
    _, once = np.unique(sentence[some] * (1 << BITS) + buckets[some], return_index=True)
    some = some[once]
    return np.bincount(sentence[some], values[some], n)


def fit(sample: pa.Table, class_weights: dict[int, float], seed: int = SEED) -> Model:
    weights, bias = np.zeros(1 << BITS), -50.0
    if len(class_weights) < 2:
        return Model(weights, 50.0 if 1 in class_weights else bias)
    docs = []
    for t in texts(iter(sample.to_batches())):
        s = sentences(t)
        pairs = np.unique(np.stack([s.sentence, s.buckets]), axis=1)
        cut = np.searchsorted(s.row[pairs[0]] if len(s.row) else pairs[0], np.arange(len(t) + 1))
        at = np.searchsorted(s.row, np.arange(len(t) + 1))
        docs += [(pairs[1, cut[i] : cut[i + 1]].astype(np.int32), (pairs[0, cut[i] : cut[i + 1]] - at[i]).astype(np.int32), at[i + 1] - at[i]) for i in range(len(t))]
    y = np.array(sample["label"].to_pylist())
    in_docs, n_docs = np.zeros((2, 1 << BITS)), np.bincount(y, minlength=2)
    for (buckets, _, _), label in zip(docs, y, strict=True):
        in_docs[label, np.unique(buckets)] += 1
    both, share = in_docs.sum(axis=0), in_docs / np.maximum(n_docs, 1)[:, None]
    pooled = both / len(docs)
    z = (share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n_docs).sum())
    known = (both >= LEAST_DOCS) & (np.abs(z) >= TELLS)
    rng, bias = np.random.default_rng(seed), -5.0
    squares, bias_square = np.full(1 << BITS, 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // len(docs)))):
        for i in rng.permutation(len(docs)):
            buckets, sentence, n = docs[i]
            if not n:
                continue
            p = _sigmoid(bias + np.bincount(sentence, weights[buckets], n))
            if y[i]:
                clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
                back = -p * clean / max(1e-9, 1 - clean)
            else:
                back = p
            back = back * min(2.0, class_weights[y[i]])
            here = known[buckets]
            touched, at = np.unique(buckets[here], return_inverse=True)
            gradient = np.bincount(at, back[sentence[here]], len(touched)) + SHRINK * weights[touched]
            squares[touched] += gradient * gradient
            weights[touched] -= RATE * gradient / np.sqrt(squares[touched])
            total = back.sum()
            bias_square += total * total
            bias -= RATE * total / np.sqrt(bias_square)
    weights[np.abs(weights) < 1e-3] = 0
    return Model(weights, float(bias))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled(documents, labels, "toxic", FOLDS, HELD_OUT))


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in texts(batches):
            scores, offending, worst = model.judged(t)
            found = pa.array(worst, pa.int64(), mask=worst < 0)
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(offending), found], ["doc_id", "score", "n_offending", "worst_sentence"])

    return score


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text; n_offending: how many of its sentences score 0.5 or more by themselves;
    worst_sentence: which one scores most, from 0, null without sentences."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = arrow(docs, _score(model), "doc_id long, score double, n_offending long, worst_sentence long")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_sentence")


def located(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, nth (from 0), sentence, score of every sentence that scores as much by itself."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in texts(batches):
            s = sentences(t)
            scores = model.sentence_scores(s)
            nth = np.arange(len(s.row)) - np.searchsorted(s.row, np.arange(len(t)))[s.row] if len(s.row) else s.row
            some = np.flatnonzero(scores >= threshold)
            found = pa.array([t.data[s.start[i] : s.end[i]].tobytes() for i in some], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id").take(pa.array(s.row[some])), pa.array(nth[some], pa.int64()), found, pa.array(scores[some])], ["doc_id", "nth", "sentence", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow(docs, locate, "doc_id long, nth long, sentence string, score double")
