"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest of the pivots, reference vectors, in order. An inverted list holds, for a
pivot and a label, the vectors that have it. Two vectors are a candidate pair if they share ``SHARED`` pivots, which are
counted inside the lists; candidates are verified by cosine in double precision. Such a pair has its rarest common pivot
among the ``NEAREST - SHARED + 1`` rarest of both, so a vector enters only those lists, and a pair counts only in the list of
its rarest common pivot. Long lists are cut into blocks, block by block: pivots are counted first, and only the pairs that
share enough are compared. Links exist as counters and spanning edges only.

Where many pivots are close to a vector, as in a large group of near copies, which of them are nearest says little. Up to
2 ``NEAREST`` - ``SHARED`` close pivots two choices of ``NEAREST`` share enough in any case; a vector with more of them within
``CLOSE`` times the angle of the threshold is dense. All that a dense vector can link with has as many pivots within one such
angle more, and those vectors, its dense ones and their surroundings, are compared with each other exactly: in the cells of
far-apart pivots, where a vector is in the cell of its nearest one, its home, and in all others that a vector it links with
may have as home, by the triangle inequality. Dense vectors enter only these lists, their surroundings both kinds.

The pivots are a bounded sample, the vectors with the smallest hashes of vec_id; their number grows with the table up to a
bound, so that lists stay short. All vectors are indexed. Equal vectors of one label enter once, with their number.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label or
vec_id link with nothing; vectors of different lengths never link; equal rows are separate vectors that link with each
other; a row without vec_id has no component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, lookup, save, ship
from .components import components, forest
from .vectors import matrix, vectors

THRESHOLD = 0.98
NEAREST, SHARED = 10, 3
#: So many pivots at least and at most, and between, one for so many distinct vectors.
PIVOTS, MOST_PIVOTS, PER_PIVOT = 256, 4096, 1024
BLOCK = 1024
#: So many numbers of candidate pairs are compared at once.
COMPARED = 1 << 20
#: Angles here are in multiples of the threshold's. Centres of cells are further apart than twice this.
CLOSE = 3
_SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centres(pivots: np.ndarray, apart: float) -> np.ndarray:
    """The first pivot and each next one that is further from those taken."""
    taken: list[int] = []
    for p in np.flatnonzero(pivots.any(axis=1)).tolist():
        if not taken or (pivots[taken] @ pivots[p]).max() < np.cos(min(apart, np.pi)):
            taken.append(p)
    return np.array(taken, np.int64)


def _near_pivots(pivots: list[list[float]], nearest: int, shared: int, threshold: float):
    link = float(np.arccos(threshold))

    def of_length(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array([(p + [0.0] * d)[:d] for p in pivots])
        unit = own / np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), 1e-300)
        return own, unit, _centres(unit, 2 * CLOSE * link)

    def near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, known = 2 * nearest - shared + 1, {}
        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy()
            out = np.zeros((len(batch), min(nearest, len(pivots))), np.int32)
            dense, home = np.zeros(len(batch), np.int32), np.full(len(batch), -1, np.int32)
            cells: list[list[int]] = [[]] * len(batch)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                own, unit, centres = known[d] = known.get(d) or of_length(int(d))
                x = _unit(matrix(v.take(pa.array(rows))))
                near = x @ own.T
                out[rows] = np.argsort(-near, axis=1, kind="stable")[:, : out.shape[1]]
                if len(pivots) < many:
                    continue
                angle = np.where(unit.any(axis=1), np.arccos(np.clip(x @ unit.T, -1, 1)), np.inf)
                far = np.partition(angle, many - 1, axis=1)[:, many - 1]
                dense[rows] = (far <= CLOSE * link) + (far <= (CLOSE + 1) * link + _SLACK).astype(np.int32)
                some = np.flatnonzero(dense[rows])
                if not len(some):
                    continue
                to = angle[some][:, centres]
                home[rows[some]] = centres[to.argmin(axis=1)]
                enters = (to <= to.min(axis=1, keepdims=True) + 2 * link + _SLACK) & (centres <= home[rows[some], None])
                for i, e in zip(rows[some].tolist(), enters, strict=True):
                    cells[i] = centres[e].tolist()
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(dense), pa.array(home), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "near", "dense", "home", "cells"])

    return near_pivots


def _verified(threshold: float, shared: int, rank: list[int]):
    def verified(group: pa.Table) -> pa.Table:
        """Links inside some short lists, or between two blocks of a long one."""
        place = np.array(rank)
        rep, copies, part, lo, hi, list_id, pivot, dense, home = (group.column(c).to_numpy() for c in ("rep", "copies", "part", "lo", "hi", "list_id", "pivot", "dense", "home"))
        order = np.lexsort((rep, list_id))
        ends = np.append(np.flatnonzero(np.diff(list_id[order])) + 1, len(order))
        out, begin = [], 0
        for end in ends:
            own = order[begin:end]
            begin = end
            if len(own) < 2:
                continue
            rows = pa.array(own)
            x = _unit(matrix(group.column("v").take(rows)))
            if pivot[own[0]] < 0:  # a cell: all are compared; a pair counts in the first of its two homes
                linked = x @ x.T >= threshold
                linked &= np.minimum(home[own][:, None], home[own][None, :]) == -1 - pivot[own[0]]
            else:  # counts first; only who shares enough is compared
                ranks, near = np.unique(place[matrix(group.column("near").take(rows)).astype(np.int64)], return_inverse=True)
                has = np.zeros((len(own), len(ranks)), np.float32)
                np.put_along_axis(has, near.reshape(len(own), -1), 1, axis=1)
                linked = has @ has.T >= shared
                before = has[:, : np.searchsorted(ranks, place[pivot[own[0]]])]
                linked &= before @ before.T == 0
                in_cells = dense[own] > 0
                linked &= ~(in_cells[:, None] & in_cells[None, :])
            if lo[own[0]] != hi[own[0]]:
                left = part[own] == lo[own]
                linked &= left[:, None] != left[None, :]
            a, b = np.nonzero(np.triu(linked, 1))
            if pivot[own[0]] >= 0 and len(a):
                step = max(1, COMPARED // x.shape[1])
                same = np.concatenate([(x[a[i : i + step]] * x[b[i : i + step]]).sum(axis=1) >= threshold for i in range(0, len(a), step)])
                a, b = a[same], b[same]
            if len(a):
                weight = np.bincount(a, copies[own][b], len(own)) + np.bincount(b, copies[own][a], len(own))
                some = np.flatnonzero(weight)
                out.append((rep[own][some], weight[some].astype(np.int64), rep[own][forest(len(own), a, b)][some]))
        columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "to"])

    return verified


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = vectors(embeddings, F.col("label").alias("label"))
    rows = save(rows.withColumn("ok", F.col("ok") & F.col("label").isNotNull()).withColumn("h", F.xxhash64("v")), "vectors")
    classes = rows.filter("ok").groupBy("label", "h", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = save(classes, "classes")
    pivots = min(MOST_PIVOTS, max(PIVOTS, classes.count() // PER_PIVOT)) if pivots is None else pivots
    found = _links(classes, threshold, pivots, nearest, shared)
    parts = components(found, "rep", "to").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # rows with one vec_id and different vectors share their links and component
    known = classes.groupBy("rep").agg(F.sum("copies").alias("_")).join(links, "rep", "left").join(parts, "rep", "left").drop("_")
    of = classes.select("label", "h", "v", "rep", "copies").join(known, "rep")
    out = rows.filter("ok").join(of, ["label", "h", "v"]).select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    rest = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, threshold: float, pivots: int, nearest: int, shared: int) -> DataFrame:
    sample = [r.v for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("v").collect()]
    if not sample:
        return classes.select("rep", F.col("copies").alias("links"), F.col("rep").alias("to"))
    width = max(map(len, sample))
    sample = [list(p) + [0.0] * (width - len(p)) for p in _unit(np.array([list(p) + [0.0] * (width - len(p)) for p in sample])).tolist()]
    shared = min(shared, len(sample), nearest)
    near = save(arrow(classes.select("label", "rep", "copies", "v"), _near_pivots(sample, nearest, shared, threshold), f"label {classes.schema['label'].dataType.simpleString()}, rep long, copies long, v {classes.schema['v'].dataType.simpleString()}, near array<int>, dense int, home int, cells array<int>"), "near")
    often = {r.p: r.n for r in near.filter("dense < 2").select(F.explode("near").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(len(sample)), key=lambda p: (often.get(p, 0), p))
    rank = [0] * len(sample)
    for i, p in enumerate(order):
        rank[p] = i
    ranks = F.array(*map(F.lit, rank))
    rarest = F.slice(F.array_sort(F.transform("near", lambda p: F.struct(F.get(ranks, p).alias("rank"), p.alias("p")))), 1, max(1, min(nearest, len(sample)) - shared + 1))
    by_pivot = F.when(F.col("dense") < 2, F.transform(rarest, lambda x: x["p"])).otherwise(F.array().cast("array<int>"))
    lists = near.withColumn("pivot", F.explode(F.concat(by_pivot, F.transform("cells", lambda c: -1 - c))))
    lists = lists.withColumn("near", F.when(F.col("pivot") >= 0, F.col("near"))).withColumn("list_id", F.xxhash64("label", F.size("v"), "pivot"))
    size = lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("list_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    total = near.count() * max(1, nearest - shared + 1)
    lists = lists.join(size, "list_id").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    bins = max(1, total // (8 * BLOCK))
    lists = lists.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.col("list_id"), F.lit(bins))).otherwise(F.lit(None).cast("long")))
    lists = lists.withColumn("own", F.when(F.col("blocks") > 1, F.col("list_id")))
    ship(classes.sparkSession)
    columns = ["bin", "own", "lo", "hi", "rep", "copies", "part", "list_id", "pivot", "dense", "home", "v", "near"]
    return save(lists.select(*columns).groupBy("bin", "own", "lo", "hi").applyInArrow(_verified(threshold, shared, rank), "rep long, links long, to long"), "links")


ORACLE = """
WITH RECURSIVE g AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(least(x, y)) AS component FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
