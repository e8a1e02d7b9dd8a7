"""N-gram Jaccard join by a MinHash LSH forest, and near-dedup on top of it.

A document's shingles are its distinct runs of ``SHINGLE`` words. It has a label in each of ``TREES`` prefix tries: a path of
MinHash values, of which the first ``floor`` are as many as a pair right at the threshold may have to share for the
target recall, and ``LONGER`` more make the path longer than that. Documents that share a whole path are most alike, those that
share a shorter prefix less so.

A document starts with its whole paths and shortens them until a pair at the threshold, with it, is missed with at most the
probability that the target recall leaves: prod(1 - threshold ** length) over the trees. Nodes of few documents cost little,
so paths through them are cut down to the floor at once. Paths through crowded nodes, which common passages make, are cut one
level by round, the least crowded first, as far as the target asks for. A node is as long as all its documents can afford, so
that two documents see the same one. What has nobody else in it at the floor is left out from the start.

Leaves, the nodes that are left, are not yet compared: each goes, as a whole, to the group of the largest leaf that most of
its documents are in, so that the many leaves of one set of near copies become one group. That is one step, so that leaves
don't chain together: a group has at most 2 ``TREES`` times as many documents as call its leaf their largest. Then pairs
within groups are verified exactly, by their shingles, in blocks of bounded size; they exist only as counters inside a task.
A pair that is in several groups counts in the first.

Copies (equal word sequences, by a keyed 128-bit digest) form a class and enter once, by their smallest doc_id.

Defined results: null and empty texts link with nothing; documents of fewer than ``SHINGLE`` words link only with their
copies; equal rows are copies of each other; rows with one doc_id and different texts are told apart by
their texts; a row without doc_id takes no part and gets no class; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Words, arrow, lookup, mix, runs, save, ship, signed, texts, windows, word_hashes
from .components import components, forest

SHINGLE = 5
THRESHOLD = 0.8
TREES, RECALL = 20, 0.9999
#: The floor is at most so long; levels of a path beyond it, and the bits that each of those has.
LONGEST, LONGER, BITS = 8, 2, 32
#: Nodes of more documents than this are crowded.
CROWDED = 64
#: A block of a group has about so many documents and so many bytes of text at most.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8 << 20


def missed(threshold: float, lengths: list[int]) -> float:
    """The probability that a pair at the threshold shares no prefix of these lengths, one in each tree."""
    return float(np.prod([1 - threshold**n for n in lengths]))


def prefix_length(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The floor: the longest prefix by which a pair at the threshold meets in some tree with this probability; 1 if none does."""
    for n in range(longest, 1, -1):
        if missed(threshold, [n] * trees) <= 1 - recall:
            return n
    return 1


def shortened(threshold: float, crowded: int, trees: int, floor: int, recall: float) -> list[int]:
    """How many levels beyond the floor a document with so many crowded paths keeps of each, the least crowded first."""
    rest = [LONGER] * crowded
    for level in range(LONGER - 1, -1, -1):
        for i in range(crowded):
            if missed(threshold, [floor] * (trees - crowded) + [floor + x for x in rest]) <= 1 - recall:
                return rest
            rest[i] = level
    return rest


def _shingles(t, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the first of each row."""
    w = Words(t)
    at = runs(w.first, w.counts, n)
    first = np.concatenate([[0], np.cumsum(np.maximum(w.counts - n + 1, 0))])
    return windows(word_hashes(t, w, 2), n)[at], first


def _class(raw: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16, key=b"boundwise words").digest()


def _signatures(trees: int, floor: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the class, counts, and the paths: a hash of the floor's values, and the other values, BITS of each, the first highest."""
        depth = floor + LONGER
        keys = np.random.default_rng(41).integers(1, 2**63, (2, trees * depth), dtype=np.uint64)
        for t in texts(batches):
            classes = np.frombuffer(b"".join(_class(t.raw(i)) for i in range(len(t))), "<i8").reshape(-1, 2)
            h, first = _shingles(t)
            n_words = np.diff(first) + (SHINGLE - 1) * (np.diff(first) > 0)
            few = np.flatnonzero(np.diff(first) == 0)
            n_words[few] = [len(t.raw(i).split()) for i in few.tolist()]
            some = np.flatnonzero(np.diff(first))
            top, rest = np.zeros((len(some), trees), np.uint64), np.zeros((len(some), trees), np.uint64)
            for tree in range(trees if len(some) else 0):
                path = np.full(len(some), tree + 1, np.uint64)
                for k in range(depth):
                    key = keys[:, tree * depth + k]
                    value = mix(np.minimum.reduceat((h ^ key[0]) * (key[1] | np.uint64(1)), first[some]))
                    if k < floor:
                        path = mix(path * np.uint64(0x9E3779B97F4A7C15) + value)
                    else:
                        rest[:, tree] |= (value >> np.uint64(64 - BITS)) << np.uint64(BITS * (depth - 1 - k))
                top[:, tree] = path
            ends = pa.array(np.concatenate([[0], np.cumsum(np.where(np.diff(first) > 0, trees, 0))]), pa.int32())
            paths = [pa.ListArray.from_arrays(ends, pa.array(signed(x.ravel()))) for x in (top, rest)]
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), t.batch.column("mark"), pa.array(classes[:, 0]), pa.array(classes[:, 1]), pa.array(n_words, pa.int64()), pa.array(np.diff(t.offsets), pa.int64()), *paths], ["doc_id", "mark", "c1", "c2", "n_words", "bytes", "top", "rest"])

    return signatures


def _in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share: a matrix."""
    n = len(sets)
    common = np.zeros((n, n), np.float64)
    every, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    begins = np.flatnonzero(new)
    many = np.diff(np.append(begins, len(every)))
    shared = np.repeat(many > 1, many)
    column = np.repeat(np.cumsum(many > 1) - 1, many)[shared]
    of = of[shared]
    for low in range(0, int((many > 1).sum()), 8192):
        here = slice(*np.searchsorted(column, [low, low + 8192]))
        m = np.zeros((n, min(8192, int(column[-1]) + 1 - low)), np.float32)
        m[of[here], column[here] - low] = 1
        common += m @ m.T
    return common


def _linked(sets: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> np.ndarray:
    """Which pairs are as similar: a matrix. left: which are of the first of two blocks, either of which may be empty; pairs within a
    block are left out."""
    sizes = np.array([len(s) for s in sets], np.float64)
    common = _in_common(sets)
    linked = common + 1e-9 >= threshold * (sizes[:, None] + sizes[None, :] - common)
    linked &= (sizes > 0)[:, None] & (sizes > 0)[None, :]
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] != left[None, :]
    return linked


def _verified(threshold: float):
    def verified(table: pa.Table) -> pa.Table:
        """Links of the documents of some small groups, or of two blocks of a large one."""
        table = table.combine_chunks()
        sets: list[np.ndarray] = []
        for batch in table.to_batches():
            for t in texts([batch]):
                h, first = _shingles(t)
                sets += [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        rep, copies, group, part, lo, hi = (table.column(c).to_numpy() for c in ("rep", "copies", "group", "part", "lo", "hi"))
        lists = table.column("groups").combine_chunks()
        groups = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        order = np.lexsort((rep, group))
        ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
        out, begin = [], 0
        for end in ends:
            own = order[begin:end]
            begin = end
            if len(own) < 2:
                continue
            two = lo[own[0]] != hi[own[0]]
            linked = _linked([sets[i] for i in own], threshold, part[own] == lo[own] if two else None)
            linked &= _in_common([groups[i][groups[i] < group[own[0]]] for i in own]) == 0
            a, b = np.nonzero(linked)
            if len(a):
                weight = linked @ copies[own].astype(np.float64)
                some = np.flatnonzero(linked.any(axis=1))
                out.append((rep[own][some], weight[some].astype(np.int64), rep[own][forest(len(own), a, b)][some]))
        columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "to"])

    return verified


def join(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), n_links (other documents as similar, copies among them),
    component_id (smallest doc_id that links reach), kept (it is that document), for each document."""
    return _judged(documents, threshold, trees, recall).drop("mark")


def _judged(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    floor = prefix_length(threshold, trees, recall=recall)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mark().alias("mark"))
    signed_ = save(arrow(docs, _signatures(trees, floor), "doc_id long, mark long, c1 long, c2 long, n_words long, bytes long, top array<long>, rest array<long>"), "signatures")
    live = signed_.filter("doc_id is not null and n_words > 0")
    classes = live.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("bytes", "top", "rest")))
    classes = save(classes.select("*", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark")).drop("first"), "classes")
    found = _links(docs, classes, threshold, trees, floor, recall)
    parts = components(found, "rep", "to").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # rows with one doc_id and different texts share their links and component, as both are by doc_id
    known = save(classes.select("c1", "c2", "rep", "copies").join(links, "rep", "left").join(parts, "rep", "left"), "known")
    out = lookup(signed_.select("doc_id", "mark", "c1", "c2", "n_words"), known, ["c1", "c2"], "left")
    alive = F.col("doc_id").isNotNull() & (F.col("n_words") > 0)
    class_id = F.when(alive, F.col("rep")).otherwise(F.col("doc_id"))
    n_links = F.when(alive, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    out = out.select("doc_id", "mark", class_id.alias("class_id"), n_links.cast("long").alias("n_links"), F.when(alive, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _leaves(classes: DataFrame, threshold: float, trees: int, floor: int, recall: float) -> DataFrame:
    """(leaf, rep), saved: the nodes in which classes meet."""
    paths = classes.select("rep", F.explode(F.arrays_zip("top", "rest")).alias("path")).select("rep", "path.top", "path.rest")
    nodes = save(paths.groupBy("top").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "nodes")
    paths = save(lookup(paths, nodes, ["top"]), "paths")
    own = Window.partitionBy("rep")
    crowded = paths.filter(F.col("n") > CROWDED).withColumn("nth", F.row_number().over(own.orderBy("n", "top"))).withColumn("of", F.count(F.lit(1)).over(own))
    table = F.array(*[F.array(*map(F.lit, shortened(threshold, max(1, k), trees, floor, recall))) for k in range(1, trees + 1)])
    # rows of one rep (texts of one doc_id) can have more paths than there are trees
    keeps = F.coalesce(F.get(F.get(table, F.least(F.col("of"), F.lit(trees)) - 1), F.col("nth") - 1), F.lit(0))
    depths = save(crowded.groupBy("top").agg(F.min(keeps).cast("int").alias("keeps")).filter("keeps > 0"), "depths")
    cut = F.when(F.col("keeps") > 0, F.expr(f"shiftrightunsigned(rest, {BITS} * ({LONGER} - keeps))"))
    leaf = F.xxhash64("top", "keeps", cut).alias("leaf")
    return save(lookup(paths, depths, ["top"], "left").select(leaf, "rep").distinct(), "leaves")


def _groups(leaves: DataFrame) -> DataFrame:
    """(rep, group, groups), saved: what is compared with each other; groups: all that the class is in."""
    sets = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.min("rep").alias("least")).filter("n > 1")
    sets = save(sets.groupBy("n", "x", "least").agg(F.min("leaf").alias("leaf")).select("leaf", "n"), "sets")  # of equal ones, one
    rows = lookup(leaves, sets, ["leaf"])
    home = F.max(F.struct("n", "leaf")).over(Window.partitionBy("rep"))["leaf"]
    rows = save(rows.withColumn("home", home), "homes")
    votes = rows.groupBy("leaf", "home").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"))
    most = votes.groupBy("leaf").agg(F.max(F.struct("votes", "home")).alias("most"), F.first("n").alias("n"))
    goes = F.when(2 * F.col("most.votes") >= F.col("n"), F.col("most.home")).otherwise(F.col("leaf"))
    goes = save(most.select("leaf", goes.alias("group")), "goes")
    out = lookup(rows.select("leaf", "rep"), goes, ["leaf"]).select("group", "rep").distinct()
    return save(out.withColumn("groups", F.sort_array(F.collect_list("group").over(Window.partitionBy("rep")))), "groups")


def _links(docs: DataFrame, classes: DataFrame, threshold: float, trees: int, floor: int, recall: float) -> DataFrame:
    """Saved (rep, links, to): a row for each class and block pair in which it has links; to is in its component."""
    # of one doc_id's texts, all take part
    held = save(classes.select("rep", "mark", "copies", "bytes", F.xxhash64("rep", "mark").alias("id"), "top", "rest"), "held")
    groups = _groups(_leaves(held.select(F.col("id").alias("rep"), "top", "rest"), threshold, trees, floor, recall)).withColumnRenamed("rep", "id")
    groups = held.drop("top", "rest").join(groups, "id")
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("all_bytes") / BLOCK_BYTES)).cast("int")
    size = save(size.select("group", blocks.alias("blocks")), "sizes")
    groups = save(lookup(groups, size, ["group"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "placed")
    total = groups.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    keys = save(groups.select(F.col("rep").alias("doc_id"), "mark").distinct(), "keys")
    near = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    near = near.withColumnRenamed("doc_id", "rep").join(groups, ["rep", "mark"])
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = max(1, (total[1] or 0) // BLOCK_BYTES + total[0] // BLOCK_DOCS)
    near = near.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    # small groups share tasks; each pair of blocks of a large one has its own
    near = near.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(bins))))
    near = near.withColumn("alone", F.when(F.col("blocks") > 1, F.col("group")))
    ship(docs.sparkSession)
    columns = ["bin", "alone", "lo", "hi", "rep", "copies", "group", "groups", "part", "text"]
    return save(near.select(*columns).groupBy("bin", "alone", "lo", "hi").applyInArrow(_verified(threshold), "rep long, links long, to long"), "links")


def distinct(documents: DataFrame, **options) -> DataFrame:
    """The documents, one of each component: the smallest doc_id. Equal rows stay or go together; rows without doc_id and empty
    texts stay."""
    gone = save(_judged(documents, **options).filter(~F.col("kept")).select("doc_id", "mark").distinct(), "gone")
    small = gone.count() <= BROADCAST_KEYS
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    return rows.join(F.broadcast(gone) if small else gone, ["doc_id", "mark"], "left_anti").select("row.*")


def _mark() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
c AS (SELECT array_to_string(ws, ' ') AS t, min(doc_id) AS rep, count(*) AS copies FROM d WHERE len(ws) > 0 GROUP BY 1),
m AS (SELECT d.doc_id, coalesce(c.rep, d.doc_id) AS rep, coalesce(copies, 1) AS copies, ws FROM d LEFT JOIN c ON c.t = array_to_string(d.ws, ' ') AND len(ws) > 0),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i, len(ws) AS n FROM m WHERE doc_id = rep),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM w),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i + 5 <= n),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k2 FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k2 + 1e-9 >= 0.8::DOUBLE * (a.k + b.k - k2)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
q AS (SELECT x, min(least(x, y)) AS component FROM r GROUP BY 1),
v AS (SELECT x, sum(copies)::BIGINT AS links FROM l JOIN (SELECT DISTINCT rep, copies FROM m) e ON e.rep = y GROUP BY 1)
SELECT m.doc_id, m.rep AS class_id, (copies - 1 + coalesce(links, 0))::BIGINT AS n_links, coalesce(component, m.rep) AS component_id,
       m.doc_id = coalesce(component, m.rep) AS kept
FROM m LEFT JOIN q ON q.x = m.rep LEFT JOIN v ON v.x = m.rep
"""
