"""Substring dedup with difference-cover anchors.

Two texts that share ``WINDOW`` words at places i and j have a shift below ``PERIOD`` that brings both places onto the
cover, as the cover's differences give every residue. So shorter windows, hashed only where a document's place modulo the
period is in the cover, meet in every long match. Where such an anchor is in two documents, it is extended: the whole
windows around it are hashed (128 bits) and each goes to the smallest document that has it.

Before a shuffle, a piece of a batch keeps for a hash only what the smallest document in it has; what the others have is
known to be repeated. A task remembers such hashes with their smallest document, so that what later pieces have of them is
known to be repeated as well: a passage that a third of all documents share goes to one place only once for each task. What
a task has no room to remember goes there once more, with the same result.

Words are told apart by 128 bits that are a short word itself, or a keyed digest of a longer one; two independent hashes of
64 bits each compare windows.

Defined results: a null or empty text has no words; a null doc_id neither removes words nor loses any; rows with one
doc_id never remove each other's words, and equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Texts, Words, arrow, mix, runs, save, signed, texts, windows, word_hashes

WINDOW = 50
#: A perfect difference set.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
STEP = 500_000
#: So many hashes of repeated passages are remembered by a task.
REMEMBERED = 1 << 18

_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _hashes(t: Texts, w: Words, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    return windows(word_hashes(t, w, seed), n)[at]


class _Seen:
    """Hashes that several documents of a task have, sorted by the first of two, with the smallest document so far."""

    def __init__(self) -> None:
        self.first, self.last, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def smallest(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of hashes is, and whether it is there."""
        at = np.searchsorted(self.first, first)
        inside = np.minimum(at, max(0, len(self.first) - 1))
        return at, (self.first[inside] == first) & (self.last[inside] == last) if len(self.first) else np.zeros(len(first), bool)

    def put(self, at: np.ndarray, known: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> None:
        """first: sorted, each once; at, known: what smallest has said to them."""
        self.doc[at[known]] = np.minimum(self.doc[at[known]], doc[known])
        new = np.flatnonzero(~known)[: max(0, REMEMBERED - len(self.first))]
        self.first, self.last, self.doc = (np.insert(old, at[new], x[new]) for old, x in ((self.first, first), (self.last, last), (self.doc, doc)))


def _first_documents(hashes: list[np.ndarray], doc: np.ndarray, mark: np.ndarray, place: np.ndarray, seen: _Seen) -> list[np.ndarray]:
    """Columns hash..., doc_id, at, later. at holds the row's mark, the place, and a last bit: known to be in two documents. Of
    equal hashes, those outside the smallest document get a hash of their own and are later; what is left of a hash has the bit if
    there were any."""
    if not len(doc):
        return [*(signed(h) for h in hashes), doc, place.astype(np.int64), np.zeros(0, bool)]
    order = np.lexsort((doc, *hashes[::-1]))
    hashes, doc, mark, place = [h[order] for h in hashes], doc[order], mark[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.any([h[1:] != h[:-1] for h in hashes], axis=0)
    group = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    first, last, least = hashes[0][begins], hashes[-1][begins], doc[begins]
    at, known = seen.smallest(first, last)
    if known.any():
        least[known] = np.minimum(least[known], seen.doc[at[known]])
    later = doc != least[group]
    shared = known.copy()
    shared[group[later]] = True
    keep = np.flatnonzero(shared)
    once = keep[np.append(True, first[keep][1:] != first[keep][:-1])] if len(keep) else keep
    seen.put(at[once], known[once], first[once], last[once], least[once])
    place = (mark << 32) | (place.astype(np.int64) << 1) | shared[group]
    own = mix(hashes[0] ^ mix(doc.view(np.uint64) + np.uint64(1)) ^ place.view(np.uint64))
    hashes[0] = np.where(later, own, hashes[0])
    return [*(signed(h) for h in hashes), doc, place, later]


def _columns(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    return (t.batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    for t in texts(batches, step=STEP):
        w = Words(t)
        at = runs(w.first, w.counts, ANCHOR)
        at = at[_ON_COVER[w.place[at] % PERIOD]]
        doc, mark = _columns(t)
        row = w.row[at]
        h, doc, at, _ = _first_documents([_hashes(t, w, at, ANCHOR, 0)], doc[row], mark[row], w.place[at], seen)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(at)], ["h", "doc_id", "at"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows that hold a repeated anchor."""
    seen = _Seen()
    for t in texts(batches, step=STEP):
        w = Words(t)
        near = np.zeros(len(w.starts) + 1, np.int64)
        lists = t.batch.column("places")
        places, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
        begin = w.first[of]
        np.add.at(near, np.maximum(begin, begin + places - PERIOD + 1), 1)
        np.add.at(near, begin + places + 1, -1)
        at = runs(w.first, w.counts, WINDOW)
        at = at[np.cumsum(near)[at] > 0]
        doc, mark = _columns(t)
        row = w.row[at]
        h1, h2, doc, at, later = _first_documents([_hashes(t, w, at, WINDOW, s) for s in (0, 1)], doc[row], mark[row], w.place[at], seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, doc, at, later)], ["h1", "h2", "doc_id", "at", "later"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in texts(batches, step=STEP):
        kept, removed = [], []
        for i, places in enumerate(t.batch.column("places").to_pylist()):
            words = t.raw(i).split()
            near = np.zeros(len(words) + 1, np.int64)
            starts = np.asarray(places or [], np.int64)
            np.add.at(near, starts, 1)
            np.add.at(near, starts + WINDOW, -1)
            gone = np.cumsum(near)[:-1] > 0
            kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]))
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), t.batch.column("mark"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64())], ["doc_id", "mark", "kept", "n_removed"])


def _spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of whole texts, joined by one space, and their number."""
    for t in texts(batches, step=STEP):
        split = [t.raw(i).split() for i in range(len(t))]
        yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), t.batch.column("mark"), pa.array([b" ".join(x) for x in split], pa.binary()).cast(pa.string()), pa.array([len(x) for x in split], pa.int64())], ["doc_id", "mark", "words", "n_words"])


def _with_marks(documents: DataFrame) -> DataFrame:
    """The rows of a doc_id are told apart by their texts' checksums."""
    return documents.withColumn("mark", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).bitwiseAND(0x7FFFFFFF))


def _by_document(found: DataFrame) -> DataFrame:
    places = F.collect_set(F.shiftright(F.col("at").bitwiseAND(0xFFFFFFFF), 1).cast("int")).alias("places")
    return found.groupBy("doc_id", F.shiftright("at", 32).alias("mark")).agg(places)


def _only(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is in keys (a saved table)."""
    keys = keys.select("doc_id", "mark")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return documents.join(keys, ["doc_id", "mark"], "left_semi")


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved tables: (doc_id, mark, places) of documents with windows to remove, their starts in words; and those documents."""
    docs = _with_marks(documents.select("doc_id", "text").filter("doc_id is not null"))
    anchors = arrow(docs, _anchors, "h long, doc_id long, at long")
    same = Window.partitionBy("h")
    anchors = anchors.withColumn("lo", F.min("doc_id").over(same)).withColumn("hi", F.max("doc_id").over(same))
    anchors = anchors.filter((F.col("lo") < F.col("hi")) | (F.col("at").bitwiseAND(1) == 1))
    anchors = save(_by_document(anchors), "anchors")
    near = save(_only(docs, anchors).dropDuplicates(["doc_id", "mark"]).join(anchors, ["doc_id", "mark"]), "near")
    found = arrow(near, _windows, "h1 long, h2 long, doc_id long, at long, later boolean")
    found = found.withColumn("lo", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
    return save(_by_document(found.filter(F.col("later") | (F.col("lo") < F.col("doc_id")))), "windows"), near


def cleaned(documents: DataFrame) -> DataFrame:
    """doc_id, mark, kept, n_removed of the documents that lose words; kept: what stays, words joined by one space."""
    found, near = repeats(documents)
    return save(arrow(near.drop("places").join(found, ["doc_id", "mark"]), _apply, "doc_id long, mark long, kept string, n_removed long"), "cleaned")


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents, without repeated windows; other texts are as they were. n_chars, where there is one, follows the text."""
    gone = cleaned(documents)
    small = gone.count() <= BROADCAST_KEYS
    keys = gone.select("doc_id", "mark")
    marked = _with_marks(documents.select(F.struct("*").alias("row"), "doc_id", "text"))
    same = marked.join(F.broadcast(keys) if small else keys, ["doc_id", "mark"], "left_anti").select("row.*")
    changed = _only(marked, keys).drop("text").join(gone.drop("n_removed"), ["doc_id", "mark"])
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.char_length("kept").cast(documents.schema["n_chars"].dataType))
    return same.unionByName(changed.select(row.alias("row")).select("row.*"))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    gone = cleaned(documents).select("doc_id", "mark", "n_removed", F.sha2("kept", 256).alias("gone_sha256"))
    every = _with_marks(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    every = arrow(every, _spaced, "doc_id long, mark long, words string, n_words long")
    every = every.select("doc_id", "mark", "n_words", F.sha2("words", 256).alias("sha256"))
    out = every.join(gone, ["doc_id", "mark"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("gone_sha256", "sha256").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i, len(ws) AS n FROM d),
s AS (SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM w),
f AS (SELECT doc_id, i, h, min(doc_id) OVER (PARTITION BY h) AS lo FROM s WHERE i + 50 <= n),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f WHERE lo < doc_id),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept, count(*) AS n_kept
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i WHERE r.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
