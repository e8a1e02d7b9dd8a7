"""Approximate nearest neighbours by collision-counting hashing, for the largest inner product.

A block of vectors is cut into ranges of similar norms, the largest first; within one, inner products order vectors as the
distances of their directions do. A range is indexed by ``PROJECTIONS`` random projections of the directions, each a sorted
array of its own. A query opens a window around its own projection in each array and widens all of them round by round, as
hash buckets of growing width would be (virtual rehashing); what comes into a window is counted, so that a vector collides
once for each window it is in. Windows are ``WIDTH`` times the round's radius to either side, so a direction at that radius is in each
with one probability, and the threshold is the number of collisions that it misses with probability ``MISS`` at most: vectors
that reach it are verified by their exact inner product.

A query is done with a range when the radius is that of the k-th best product so far: whatever is better is nearer, and has
had its chance. It is done with the block when no range left is long enough to hold anything better. So the share that is
verified follows the data, and the recall doesn't depend on it. Every vector is in the index of its block; every query
visits every block, and the blocks' best are merged.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id take no
part; only vectors of one length are compared; a query is asked once for each distinct row that has its vec_id; rows with
the query's vec_id are no candidates; equal rows are separate candidates; an inner product that is too large for a double is
infinite, with its sign; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, ship
from .vectors import matrix, vectors

NEIGHBOURS = 20
PROJECTIONS, WIDTH, MISS = 128, 2.0, 0.1
#: Radii of the rounds: the first, and the growth.
RADIUS, GROWTH = 0.05, 1.1
#: Norms of a range differ by this factor at most; the last of so many ranges holds all shorter vectors.
RATIO, RANGES = 1.4, 32
BLOCK, QUERIES = 8192, 8192
SEED = 10
#: Inner products of directions are compared with this much slack.
_SLACK = 1e-9


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The most collisions that a direction at the radius of a round reaches, or else with this probability at most."""
    p, below = math.erf(width / math.sqrt(2)), 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return max(1, k)
    return projections


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, the largest component of each vector, and its norm in multiples of that: no square overflows."""
    largest = np.abs(x).max(axis=1)
    y = x / largest[:, None]
    norms = np.sqrt((y * y).sum(axis=1))
    return y / norms[:, None], largest, norms


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one vector; rounding doesn't depend on a row's place."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * q).sum(axis=1)
        huge = ~np.isfinite(out)
        if huge.any():
            y, largest, norms = directions(x[huge])
            own, most, norm = directions(q[None, :])
            out[huge] = (y * own[0]).sum(axis=1) * norms * norm[0] * largest * most[0]
    return out


class Range:
    """Sorted projections of some directions. rows: their places; norms: in descending order."""

    def __init__(self, y: np.ndarray, rows: np.ndarray, norms: np.ndarray, lines: np.ndarray):
        self.y, self.rows, self.norms, self.most = y, rows, norms, float(norms[0])
        at = (y @ lines).T
        order = np.argsort(at, axis=1, kind="stable")
        self.apart = 4 * float(np.abs(at).max()) + 8  # the arrays end to end, too far apart for a window to reach the next
        self.line = np.arange(len(at)) * self.apart
        self.sorted = (np.take_along_axis(at, order, axis=1) + self.line[:, None]).ravel()
        self.order = order.ravel()
        self.ends = (np.arange(len(at) + 1) * len(y)).astype(np.int64)

    def widened(self, at: np.ndarray, width: float, low: np.ndarray | None, high: np.ndarray | None):
        """How often each direction comes newly into windows of this half width around at, once those from low to high were counted."""
        reach = min(width, self.apart / 2)
        centre = np.clip(at, -self.apart / 4, self.apart / 4) + self.line
        new_low, new_high = np.searchsorted(self.sorted, centre - reach, "left"), np.searchsorted(self.sorted, centre + reach, "right")
        if low is None or high is None:
            if 2 * int((new_high - new_low).sum()) > len(self.order):  # fewer are outside
                return len(self.line) - self._counted((self.ends[:-1], new_low), (new_high, self.ends[1:])), new_low, new_high
            return self._counted((new_low, new_high)), new_low, new_high
        return self._counted((new_low, low), (high, new_high)), new_low, new_high

    def _counted(self, *spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        order = self.order
        parts = [order[a:b] for begins, ends in spans for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=len(self.y))


class Index:
    """A block of vectors."""

    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS, seed: int = SEED):
        self.x, self.width, self.need = x, width, threshold(projections, width, miss)
        y, largest, norms = directions(x)
        norms = largest / largest.max() * norms
        self.lines = np.random.default_rng(seed).standard_normal((x.shape[1], projections))
        rows = np.argsort(-norms, kind="stable")
        self.ranges, begin = [], 0
        while begin < len(rows):
            left = norms[rows[begin:]]
            upto = begin + (int(np.searchsorted(-left, -left[0] / RATIO, "right")) if len(self.ranges) < RANGES - 1 else len(left))
            some = rows[begin:upto]
            self.ranges.append(Range(y[some], some, norms[some], self.lines))
            begin = upto
        self.guesses = [0] * len(self.ranges)
        self.verified = 0

    def found(self, query: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best for a query: all that were verified, but those clearly worse than the k best of them.
        other: which rows may be found."""
        direction = directions(query[None, :])[0][0]
        at = direction @ self.lines
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        for nth, r in enumerate(self.ranges):
            best = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
            if best > r.most * (1 + _SLACK):
                break
            # the round before the one that the last query ended with
            level, done, counts = max(0, self.guesses[nth] - 1), ~other[r.rows], np.zeros(len(r.rows), np.int64)
            low = high = None
            while True:
                radius = RADIUS * GROWTH**level
                more, low, high = r.widened(at, self.width * radius, low, high)
                counts += more
                new = np.flatnonzero((counts >= self.need) & ~done)
                if len(new):
                    done[new] = True
                    self.verified += len(new)
                    rows = np.concatenate([rows, r.rows[new]])
                    scores = np.concatenate([scores, (r.y[new] @ direction) * r.norms[new]])
                    if len(scores) > 4 * k:  # the k best, and what is as good
                        keep = scores >= np.partition(scores, -k)[-k] - _SLACK
                        rows, scores = rows[keep], scores[keep]
                best = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
                cosine = best / r.most if r.most > 0 and best > -np.inf else -1.0
                if radius >= 2 or radius * radius >= 2 - 2 * max(-1.0, cosine) or done.all():
                    break
                level += 1
            self.guesses[nth] = level
        return rows

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int = NEIGHBOURS):
        """(query's row, id, inner product) of the k best for each query, ties to the smaller id."""
        out = []
        for i, query in enumerate(queries):
            found = self.found(query, ids != own[i], k)
            scores = products(self.x[found], query)
            best = np.lexsort((ids[found], -scores))[:k]
            out.append((np.full(len(best), i), ids[found][best], scores[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def _searched(k: int):
    def searched(group: pa.Table) -> pa.Table:
        is_query = group.column("query").to_numpy(zero_copy_only=False)
        ids, v = group.column("vec_id").to_numpy(), group.column("v").combine_chunks()
        asked, held = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(asked) and len(held):
            held = held[np.argsort(ids[held], kind="stable")]
            row, found, score = Index(matrix(v.take(pa.array(held)))).search(matrix(v.take(pa.array(asked))), ids[held], ids[asked], k)
            empty = [ids[asked][row], found, score]
        return pa.table([pa.array(c) for c in empty], ["query_id", "vec_id", "score"])

    return searched


def nearest(embeddings: DataFrame, queries: Column | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates found for each query; queries: a condition on vec_id."""
    rows = save(vectors(embeddings).filter("ok").select("vec_id", "v", F.size("v").alias("d")), "vectors")
    ask = F.col("vec_id") % 20 == 0 if queries is None else queries
    asked = rows.filter(ask).distinct()
    n, n_asked = rows.count(), asked.count()
    blocks, sets = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERIES))
    # by place in the saved table, so that rows of one vec_id spread as well
    held = rows.withColumn("b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    asked = asked.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = held.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))
    ship(embeddings.sparkSession)
    found = both.select("d", "b", "s", "vec_id", "v", "query").groupBy("d", "b", "s").applyInArrow(_searched(k), "query_id long, vec_id long, score double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
