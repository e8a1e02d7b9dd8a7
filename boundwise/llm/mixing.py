"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sources ask for ``share`` times all words, split by weight; a source's target stops at ``most`` times its size and the
excess goes to the others by weight. The targets are cut into blocks of ``block`` words, and the blocks are seats: first
the sources, then each source's shards (a bounded number of documents each) get them by highest quotients. A shard lays
its documents end to end in a seeded order, takes as many whole passes as its seats fill, and the rest as a seeded
cyclic run of blocks.

A document's shard and its place there come from its doc_id and size, so that rows without doc_id, or with one, spread. Sources
are apportioned in one task, and so are the shards of a source: one row each, of up to ``SHARD_DOCS`` documents.

Defined results: a null text has no words and is never taken; a null source is a source, the last one; a null doc_id is
ordered as an empty one; equal rows are separate documents; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

WEIGHTS = (5, 2, 1)
SHARE_HALVES = 3  # 150 %
MOST = 2
BLOCK = 64
SHARD_DOCS = 8192
SEED = 20


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """60 bits of the parts' MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, words): adds nth, weight, target and total."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int")).cast("long")
    everyone = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "nth")
    up_to, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    lcm = 1
    for x in WEIGHTS:
        lcm *= x
    out = sources.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", w)
    out = out.withColumn("ratio", F.col("words") * F.floor(F.lit(lcm) / F.col("weight"))).withColumn("total", F.sum("words").over(everyone))
    # level: what one unit of weight gets if all sources before this one stop at their limit
    out = out.withColumn("left2", SHARE_HALVES * F.col("total") - 2 * MOST * F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    out = out.withColumn("weights", F.sum("weight").over(onward))
    out = out.withColumn("stops", 2 * MOST * F.col("words") * F.col("weights") <= F.col("left2") * F.col("weight"))
    first = F.min(F.when(~F.col("stops"), F.struct("ratio", "nth", "left2", "weights"))).over(everyone)
    out = out.withColumn("open", first)
    level = (F.col("weight") * F.col("open.left2")).cast("double") / (2 * F.col("open.weights")).cast("double")
    return out.withColumn("target", F.when(F.col("stops"), (MOST * F.col("words")).cast("double")).otherwise(level)).drop("ratio", "left2", "weights", "stops", "open")


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds got: the seats (a column that is equal within a group) go to the parties with the highest votes / (2 got + 1).

    All parties start from their rounded share. What that gives too few or too many is then added by the highest next
    quotients or taken by the lowest last ones; each party brings only as many quotients as it can win or lose.
    """
    own = Window.partitionBy(*group)
    v, all_votes = F.col(votes).cast("double"), F.sum(F.col(votes).cast("double")).over(Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = parties.withColumn("_all", all_votes)
    out = out.withColumn("_base", F.when(F.col("_all") > 0, F.floor(v * F.col(seats) / F.col("_all") + 0.5)).otherwise(0).cast("long"))
    out = out.withColumn("_short", F.col(seats) - F.sum("_base").over(own)).withColumn("_n", F.count(F.lit(1)).over(own))
    tries = (F.ceil(F.when(F.col("_all") > 0, v / F.col("_all")).otherwise(0.0) * (F.abs("_short") + F.col("_n"))) + 2).cast("long")
    rows = out.filter((F.col("_short") != 0) & (v > 0)).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), tries)))
    add = F.col("_short") > 0
    rows = rows.filter(add | (F.col("_base") - F.col("_j") >= 1))
    quotient = F.when(add, -(v / (2 * (F.col("_base") + F.col("_j")) + 1))).otherwise(v / (2 * (F.col("_base") - F.col("_j")) - 1))
    place = Window.partitionBy(*group).orderBy("_q", F.when(add, F.col(key)).otherwise(-F.col(key)), "_j")
    rows = rows.withColumn("_q", quotient).withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= F.abs("_short"))
    changed = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(key).alias("_key")).agg(F.sum(F.signum("_short")).cast("long").alias("_change"))
    on = F.col(key) == F.col("_key")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = out.join(changed, on, "left").withColumn("got", F.col("_base") + F.coalesce("_change", F.lit(0)))
    return out.drop("_all", "_base", "_short", "_n", "_key", "_change", *[f"_g{i}" for i in range(len(group))])


def plan(docs: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """docs (source, doc_id, size and any others): adds source_size, target, whole (passes), lo and hi (places of the shard's
    run of blocks, from the document's first word), turn (how far that run's next lap is), taken."""
    docs = docs.withColumn("_place", seeded(F.lit(seed), F.col("doc_id"), F.col("size")))
    light = docs.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n_docs"))
    src = targets(light).withColumn("blocks", F.floor((SHARE_HALVES * F.col("total") + block) / (2 * block)).cast("long"))
    src = sainte_lague(src.withColumn("_one", F.lit(1)), ["_one"], "nth", "target", "blocks").withColumnRenamed("got", "quota")
    src = src.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
    src = src.select(F.col("source").alias("_src"), "nth", "target", "words", "shards", "quota")
    docs = docs.join(src, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    docs = docs.withColumn("_shard", F.col("_place") % F.col("shards"))
    shards = docs.groupBy("nth", "_shard").agg(F.sum("size").alias("length"), F.first("quota").alias("quota"))
    shards = sainte_lague(shards, ["nth"], "_shard", "length", "quota")
    asked = F.col("got") * block
    shards = shards.withColumn("whole", F.when(F.col("length") > 0, F.least(F.lit(MOST), F.floor(asked / F.col("length")))).otherwise(0).cast("long"))
    shards = shards.withColumn("laps", F.ceil(F.col("length") / block).cast("long"))
    rest = F.when(F.col("whole") < MOST, F.least(F.col("laps"), F.floor((asked - F.col("whole") * F.col("length") + F.lit(block // 2)) / block))).otherwise(0).cast("long")
    shards = shards.withColumn("rest", rest).withColumn("begin", F.when(F.col("laps") > 0, seeded(F.lit(seed), F.col("nth"), F.col("_shard"), F.lit("run")) % F.col("laps")).otherwise(0) * block)
    shards = shards.select(F.col("nth").alias("_n"), F.col("_shard").alias("_s"), "whole", "begin", (F.col("rest") * block).alias("run"), (F.col("laps") * block).alias("turn"))
    docs = docs.join(shards, (F.col("nth") == F.col("_n")) & (F.col("_shard") == F.col("_s")))
    line = Window.partitionBy("nth", "_shard").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    docs = docs.withColumn("lo", F.col("begin") - F.col("_at")).withColumn("hi", F.col("begin") + F.col("run") - F.col("_at"))
    docs = docs.withColumn("taken", (F.col("whole") * F.col("size") + inside(F.lit(0)) + inside(F.col("turn"))).cast("long"))
    return docs.withColumnRenamed("words", "source_size").drop("_place", "_shard", "shards", "quota", "_n", "_s", "nth", "begin", "run", "_at")


def inside(back: Column) -> Column:
    """How many of a document's words the run holds, moved back by so much."""
    return F.greatest(F.lit(0), F.least(F.col("hi") - back, F.col("size")) - F.greatest(F.col("lo") - back, F.lit(0)))


def quotas(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    docs = save(documents.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of documents: each whole pass over a document is a row, and so is each run of words that
    the last pass takes of it, its words joined by one space. n_chars, where there is one, follows the text."""
    docs = documents.select(F.struct("*").alias("row"), "doc_id", "source", "text", n_words("text").alias("size"))
    docs = plan(docs, **options).filter((F.col("taken") > 0) & (F.col("size") > 0))
    piece = lambda back: F.when(inside(back) > 0, F.struct(F.greatest(F.col("lo") - back, F.lit(0)).alias("from"), inside(back).alias("n")))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("n")), F.col("whole").cast("int"))
    docs = docs.withColumn("part", F.explode(F.concat(whole, F.array_compact(F.array(piece(F.lit(0)), piece(F.col("turn")))))))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("part.from") + 1).cast("int"), F.col("part.n").cast("int"))
    docs = docs.withColumn("text", F.when(F.col("part.n") == F.col("size"), F.col("text")).otherwise(F.array_join(words, " ")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return docs.select(row.alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 15))::BIGINT AS place
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS words, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, sum(words) OVER ()::BIGINT AS total FROM s0),
s2 AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *, words * (10 // weight) AS ratio FROM s2),
s4 AS (SELECT *, 3 * total - 4 * coalesce(sum(words) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
              sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s3),
s5 AS (SELECT *, 4 * words * weights <= left2 * weight AS stops FROM s4),
lev AS (SELECT left2 AS l2, weights AS lw FROM s5 WHERE NOT stops ORDER BY ratio, nth LIMIT 1),
s6 AS (SELECT s5.*, CASE WHEN stops THEN (2 * words)::DOUBLE ELSE (weight * l2)::DOUBLE / (2 * lw)::DOUBLE END AS target,
              ((3 * total + 64) // 128)::BIGINT AS blocks, ceil(n_docs / 8192.0)::BIGINT AS shards
       FROM s5 LEFT JOIN lev ON true),
a1 AS (SELECT *, sum(target) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS allv FROM s6),
a2 AS (SELECT *, CASE WHEN allv > 0 THEN floor(target * blocks / allv + 0.5)::BIGINT ELSE 0 END AS base FROM a1),
a3 AS (SELECT *, (blocks - sum(base) OVER ())::BIGINT AS short, count(*) OVER () AS n FROM a2),
aq AS (SELECT nth, short, row_number() OVER (ORDER BY CASE WHEN short > 0 THEN -(target / (2 * (base + j) + 1)) ELSE target / (2 * (base - j) - 1) END,
              CASE WHEN short > 0 THEN nth ELSE -nth END, j) AS place
       FROM (SELECT *, unnest(range(0, abs(short) + n + 3)) AS j FROM a3 WHERE short <> 0 AND target > 0) WHERE short > 0 OR base - j >= 1),
ac AS (SELECT nth, sum(sign(short))::BIGINT AS change FROM aq WHERE place <= abs(short) GROUP BY nth),
src AS (SELECT a3.source, a3.nth, a3.target, a3.words, a3.shards, a3.base + coalesce(ac.change, 0) AS quota FROM a3 LEFT JOIN ac USING (nth)),
e AS (SELECT d.*, src.nth, src.target, src.words, src.quota, d.place % src.shards AS shard FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
h0 AS (SELECT nth, shard, sum(size)::BIGINT AS length, any_value(quota) AS quota FROM e GROUP BY nth, shard),
h1 AS (SELECT *, sum(length::DOUBLE) OVER (PARTITION BY nth ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS allv FROM h0),
h2 AS (SELECT *, CASE WHEN allv > 0 THEN floor(length::DOUBLE * quota / allv + 0.5)::BIGINT ELSE 0 END AS base FROM h1),
h3 AS (SELECT *, (quota - sum(base) OVER (PARTITION BY nth))::BIGINT AS short, count(*) OVER (PARTITION BY nth) AS n FROM h2),
hq AS (SELECT nth, shard, short, row_number() OVER (PARTITION BY nth ORDER BY CASE WHEN short > 0 THEN -(length::DOUBLE / (2 * (base + j) + 1)) ELSE length::DOUBLE / (2 * (base - j) - 1) END,
              CASE WHEN short > 0 THEN shard ELSE -shard END, j) AS place
       FROM (SELECT *, unnest(range(0, abs(short) + n + 3)) AS j FROM h3 WHERE short <> 0 AND length > 0) WHERE short > 0 OR base - j >= 1),
hc AS (SELECT nth, shard, sum(sign(short))::BIGINT AS change FROM hq WHERE place <= abs(short) GROUP BY nth, shard),
h4 AS (SELECT h3.*, h3.base + coalesce(hc.change, 0) AS got FROM h3 LEFT JOIN hc USING (nth, shard)),
h5 AS (SELECT *, CASE WHEN length > 0 THEN least(2, got * 64 // length) ELSE 0 END AS whole, (length + 63) // 64 AS laps FROM h4),
h6 AS (SELECT *, CASE WHEN whole < 2 THEN least(laps, (got * 64 - whole * length + 32) // 64) ELSE 0 END * 64 AS run,
              CASE WHEN laps > 0 THEN ('0x' || substr(md5('20|' || nth || '|' || shard || '|run'), 1, 15))::BIGINT % laps ELSE 0 END * 64 AS begin0
       FROM h5),
f AS (SELECT e.doc_id, e.size, e.words, e.target, h6.whole, h6.run, h6.begin0, h6.laps * 64 AS turn,
             coalesce(sum(e.size) OVER (PARTITION BY e.nth, e.shard ORDER BY e.place, e.doc_id, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0
      FROM e JOIN h6 USING (nth, shard))
SELECT doc_id, size, words AS source_size, target,
       (whole * size + greatest(0, least(begin0 + run - pos0, size) - greatest(begin0 - pos0, 0))
        + greatest(0, least(begin0 + run - pos0 - turn, size) - greatest(begin0 - pos0 - turn, 0)))::BIGINT AS taken
FROM f
"""
