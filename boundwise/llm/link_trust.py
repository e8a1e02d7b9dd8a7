"""URL filters: rules, and link-graph propagation for what no rule decides.

Hosts are nodes; a page's links to other hosts are edges, weighted by their number. Trust starts at hosts by how many of
their pages the rules allow and follows links (personalised PageRank); distrust starts by how many they block and follows
links backwards, from a host to those that link to it. Mass at hosts without further links returns to the seeds. A host is
blocked if its distrust is above its trust, and it holds more than ``DENSITY`` of what it would get as a seed, were all its
pages blocked; its pages that no rule fits share its verdict.

Only DataFrame functions; edges and pages of a host are pre-aggregated before each shuffle.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; a null page has
no links; equal rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, lookup, save


class Rule(NamedTuple):
    """A few rules are meant, as a parameter; each is a condition in the plan."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
FOLLOW, CHANGE, DENSITY = 0.85, 1e-6, 0.5


def rounds_to(change: float, follow: float) -> int:
    """Rounds after which the ranks change by less than this share of the seeds, whatever the graph: round k moves no more than
    (1 - follow) * follow**k of them."""
    return max(1, math.floor(math.log(change / (1 - follow)) / math.log(follow)) + 1) if follow > 0 else 1


ROUNDS = rounds_to(CHANGE, FOLLOW)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: str) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, and the longest fitting rule with its verdict."""
    out = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; relative ones stay on the page's host."""
    out = pages.select(host_of("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    return out.withColumn("dst", lower(F.col("dst"))).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, follow: float = FOLLOW, rounds: int | None = None, change: float = CHANGE) -> DataFrame:
    """(host, mass): PageRank from seeds (host, seed) along edges (src, dst, n); all mass is the seeds'."""
    return _propagated(seeds, edges, follow, rounds, change)[0]


def _propagated(seeds: DataFrame, edges: DataFrame, follow: float = FOLLOW, rounds: int | None = None, change: float = CHANGE) -> tuple[DataFrame, float]:
    """The ranks, and the share of a seed that its host has of it by itself. Each round's ranks are saved; it ends when the ranks
    change by less than this share of the seeds, as they do after some rounds on any graph; rounds is for fewer.

    What a host without links would pass on goes back to the seeds, by their shares. That only makes all ranks larger by one
    factor, so it is done once, at the end."""
    total = seeds.agg(F.sum("seed")).first()[0] or 0
    if not total or edges.isEmpty():
        return seeds.select("host", F.col("seed").cast("double").alias("mass")), 1.0
    with Steps(seeds.sparkSession) as steps:
        out = edges.groupBy("src").agg(F.sum("n").alias("all"))
        shares = save(lookup(edges, save(out, "out"), ["src"]).select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
        start = ranks = save(seeds.select("host", (F.col("seed") * (1 - follow)).alias("mass")), "ranks")
        for _ in range(rounds_to(change, follow) if rounds is None else rounds):
            moved = lookup(shares, ranks.withColumnRenamed("host", "src"), ["src"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * follow).alias("mass"))
            rows = start.unionByName(moved).withColumn("old", F.lit(0.0)).unionByName(ranks.select("host", F.lit(0.0).alias("mass"), F.col("mass").alias("old")))
            both = save(rows.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), "ranks")
            moved_by, held = both.agg(F.sum(F.abs(F.col("mass") - F.col("old"))), F.sum("mass")).first()
            ranks = both.select("host", "mass")
            if moved_by < change * total:
                break
        return steps.keep(ranks.select("host", (F.col("mass") * (total / held)).alias("mass")), "ranks"), (1 - follow) * total / held


def hosts(pages: DataFrame, rules: Sequence[Rule] = RULES, follow: float = FOLLOW, density: float = DENSITY) -> DataFrame:
    """host, n_pages, trust, distrust, blocked of every host that has pages."""
    is_ = lambda v: F.sum((F.col("ruled") == v).cast("long")).cast("double")
    seen = ruled(pages, rules).filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(is_("allow"), F.lit(0.0)).alias("allowed"), F.coalesce(is_("block"), F.lit(0.0)).alias("banned"))
    seen, edges = save(seen, "hosts"), save(links(pages), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust, _ = _propagated(seen.select("host", F.col("allowed").alias("seed")), edges, follow)
    distrust, own = _propagated(seen.select("host", F.col("banned").alias("seed")), back, follow)
    out = seen.join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
    out = out.select("host", "n_pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return out.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") > density * own * F.col("n_pages")))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    judged_hosts = save(hosts(pages, rules, **options).select("host", "blocked"), "judged")
    out = lookup(ruled(pages, rules), judged_hosts, ["host"], "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))
