"""Registered queries with DuckDB SQL for those that another engine can compute.

The portable (MD5) hash lets another engine repeat a sketch register by register; queries named so run real sketches.
``exact_rank_*`` are the exact rank rule; ``approx_quartiles_small`` are sketches that still hold all values, which give just
that. ``*_bounds`` and the queries of sessions run native sketches, whose values aren't repeatable: they report exact numbers
and whether the sketch's value is within its bounds of them, which the SQL expects to be so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bounds
from ..operators import frequency, hll, quantiles
from ..session import Session
from ..sources import registry as reg
from ..streaming import estimates, windowed
from . import statements as st
from .calls import rewritten

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
EPSILON, CONFIDENCE = 0.05, 0.90
SEED = 7

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_oracles)


def _all() -> None:
    """Those of the other module register themselves."""
    from . import behaviour  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users, quartiles, the frequency of a user and the three most frequent users by event type, in one statement."""
    views(spark, sf_dir, "events")
    return spark.sql(rewritten(f"""
      SELECT event_type, approx_count_distinct(user_id, {EPSILON}, {CONFIDENCE}) AS users,
             approx_25(value, {EPSILON}, {CONFIDENCE}) AS q25, approx_median(value, {EPSILON}, {CONFIDENCE}) AS q50,
             approx_75(value, {EPSILON}, {CONFIDENCE}) AS q75, approx_freq(user_id, 1, {EPSILON}, {CONFIDENCE}) AS user_1,
             approx_top_k(user_id, 3, {EPSILON}, {CONFIDENCE}) AS top_users
      FROM events GROUP BY event_type ORDER BY event_type"""))


# exact

_EXACT = {
    "exact_count_distinct": "SELECT count(DISTINCT user_id) AS n FROM events",
    "exact_freq": "SELECT count(*) AS n FROM events WHERE event_type = 'click'",
    "exact_topk": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "exact_join_window": """SELECT n_name, o_orderkey, total, nth FROM (SELECT n_name, o_orderkey, round(o_totalprice, 2) AS total,
        CAST(row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS nth
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) x WHERE nth <= 3""",
    "exact_setops_cube": """SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n FROM lineitem
        GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT 'all', 'all', count(*) FROM orders""",
}


def _through_session(sql: str, *names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        with Session(spark, hash_seed=SEED) as session:
            return session.sql(sql)

    return run


for _name, _sql in _EXACT.items():
    _queries[_name], _oracles[_name] = _through_session(_sql), _sql


@query("SELECT quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem")
def exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    with Session(spark, hash_seed=SEED) as session:
        return session.sql("SELECT percentile(l_extendedprice, 0.5) AS median FROM lineitem")


# HyperLogLog, by registers

P = bounds.hll_precision(EPSILON, CONFIDENCE).value


def _rho(value: str, source: str, by: str = "", p: int = P, seed: int = SEED) -> str:
    """DuckDB: by, idx and rho of the registers."""
    rest = 60 - p
    comma = f"{by}, " if by else ""
    return f"""h AS (SELECT {comma}('0x' || substr(md5('{seed}|' || {value}::VARCHAR), 1, 15))::BIGINT AS h FROM {source}),
      i AS (SELECT {comma}(h >> {rest})::INT AS idx, h & {(1 << rest) - 1} AS rest FROM h WHERE h IS NOT NULL),
      regs AS (SELECT {comma}idx, max(CASE WHEN rest = 0 THEN {rest + 1} ELSE {rest} - length(bin(rest)) + 1 END)::INT AS rho FROM i GROUP BY {comma}idx)"""


def _estimate(by: str = "", p: int = P, name: str = "estimate") -> str:
    m = 1 << p
    comma, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""s AS (SELECT {comma}count(*)::DOUBLE AS filled, coalesce(sum(pow(2.0::DOUBLE, -rho)), 0) AS powers FROM regs{group}),
      e AS (SELECT {comma}filled, ({hll.alpha(m)!r}::DOUBLE * {m}::DOUBLE * {m}::DOUBLE) / (powers + ({m} - filled)) AS raw FROM s)
      SELECT {comma}round(CASE WHEN filled = 0 THEN 0 WHEN raw <= 2.5::DOUBLE * {m} AND filled < {m} THEN {m}::DOUBLE * ln({m}::DOUBLE / ({m} - filled)) ELSE raw END, 6) AS {name} FROM e"""


def _distinct(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    out = hll.estimate(hll.registers(df, F.col(value), P, by, SEED, portable=True), P, by)
    return out.withColumn("estimate", F.round("estimate", 6))


@query(f"WITH {_rho('o_custkey', 'orders')} SELECT idx, rho FROM regs")
def hll_registers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.registers(table(spark, sf_dir, "orders"), F.col("o_custkey"), P, seed=SEED, portable=True)


@query(f"WITH {_rho('user_id', 'events')}, {_estimate()}")
def approx_count_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(table(spark, sf_dir, "events"), "user_id")


@query(f"WITH {_rho('user_id', 'events', 'event_type')}, {_estimate('event_type')}")
def approx_count_distinct_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(table(spark, sf_dir, "events"), "user_id", ["event_type"])


@query(f"WITH {_rho('l_orderkey', 'lineitem WHERE l_quantity > 40')}, {_estimate()}")
def approx_count_distinct_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(table(spark, sf_dir, "lineitem").filter("l_quantity > 40"), "l_orderkey")


@query(f"WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), {_rho('o_orderkey', 'j', 'c_mktsegment')}, {_estimate('c_mktsegment')}")
def approx_count_distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return _distinct(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey", ["c_mktsegment"])


@query(f"WITH {_rho('l_orderkey', 'lineitem')} SELECT idx, rho FROM regs")
def hll_union_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = hll.registers(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), P, ["l_linenumber"], SEED, portable=True)
    return hll.merged(parts)


# Count-Min

W, D, _ = bounds.cms_dims(EPSILON, CONFIDENCE)


def _cells(value: str, source: str, name: str = "cells") -> str:
    return f"""{name}_b AS (SELECT unnest(range(0, {D})) AS row, {value}::VARCHAR AS v FROM {source} WHERE {value} IS NOT NULL),
      {name} AS (SELECT row::INT AS row, (('0x' || substr(md5(({SEED} + row)::VARCHAR || '|' || v), 1, 15))::BIGINT % {W}) AS bucket, count(*) AS c FROM {name}_b GROUP BY 1, 2)"""


def _asked(targets: str, value: str) -> str:
    return f"""t AS ({targets}), p AS (SELECT t.{value}, unnest(range(0, {D})) AS row FROM t),
      q AS (SELECT {value}, row, ('0x' || substr(md5(({SEED} + row)::VARCHAR || '|' || {value}::VARCHAR), 1, 15))::BIGINT % {W} AS bucket FROM p)
      SELECT {value}, min(coalesce(c, 0))::BIGINT AS estimate FROM q LEFT JOIN cells USING (row, bucket) GROUP BY {value}"""


def _events_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.cells(table(spark, sf_dir, "events"), F.col("user_id"), W, D, seed=SEED, portable=True)


@query(f"WITH {_cells('user_id', 'events')} SELECT row, bucket, c FROM cells")
def cms_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_cells(spark, sf_dir)


@query(f"WITH {_cells('user_id', 'events')} SELECT row, bucket, c FROM cells")
def cms_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = frequency.cells(table(spark, sf_dir, "events"), F.col("user_id"), W, D, ["event_type"], SEED, portable=True)
    return frequency.merged_cells(parts)


@query(f"WITH {_cells('user_id', 'events')}, {_asked('SELECT DISTINCT user_id FROM events', 'user_id')}")
def approx_freq_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").filter("user_id is not null").distinct()
    return frequency.estimates(_events_cells(spark, sf_dir), users, "user_id", W, D, SEED, portable=True)


@query(f"WITH {_cells('user_id', 'events')}, {_asked('SELECT -1::BIGINT AS user_id UNION ALL SELECT -2', 'user_id')}")
def approx_freq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = spark.range(1, 3).select((-F.col("id")).alias("user_id"))
    return frequency.estimates(_events_cells(spark, sf_dir), absent, "user_id", W, D, SEED, portable=True)


@query(f"""WITH {_cells('o_custkey', 'orders', 'x')}, {_cells('c_custkey', 'customer', 'y')},
  s AS (SELECT row, sum(x.c * coalesce(y.c, 0)) AS s FROM x LEFT JOIN y USING (row, bucket) GROUP BY row),
  e AS (SELECT count(*) AS exact FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT min(s)::BIGINT AS estimate, any_value(exact) AS exact, min(s) >= any_value(exact) AS covers FROM s, e""")
def join_size_orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a join from the sketches of its two columns, beside the true one."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a, b = (frequency.cells(t, F.col(c), W, D, seed=SEED, portable=True) for t, c in ((orders, "o_custkey"), (customer, "c_custkey")))
    exact = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("exact"))
    return frequency.join_size(a, b).crossJoin(F.broadcast(exact)).withColumn("covers", F.col("estimate") >= F.col("exact"))


# top-k

@query("SELECT event_type AS value, count(*) AS estimate, 0::BIGINT AS error FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def approx_topk_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = bounds.topk_capacity(3, EPSILON).value
    return frequency.top_k(frequency.summary(table(spark, sf_dir, "events"), F.col("event_type"), capacity), 3)


#: Three frequent values in a long tail, far more different ones than a summary has counters.
_SKEWED = "CASE WHEN l_orderkey % 5 = 0 THEN -1 WHEN l_orderkey % 8 = 1 THEN -2 WHEN l_orderkey % 9 = 2 THEN -3 ELSE l_partkey * 7 + l_linenumber END"


@query(f"""WITH v AS (SELECT ({_SKEWED})::BIGINT AS value FROM lineitem) SELECT value, count(*) AS exact, true AS within_eps, 20::BIGINT AS counters FROM v GROUP BY 1
  ORDER BY 2 DESC LIMIT 3""")
def topk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent values from a summary that has had to evict thousands."""
    items, k = table(spark, sf_dir, "lineitem").select(F.expr(_SKEWED).cast("long").alias("v")), 3
    capacity = bounds.topk_capacity(k, EPSILON).value
    best = frequency.top_k(frequency.summary(items, F.col("v"), capacity), k)
    true = items.groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("exact"))
    n = items.agg(F.count("v").alias("n"))
    out = best.join(true, "value").crossJoin(F.broadcast(n))  # one row
    within = F.col("exact").between(F.col("estimate") - F.col("error"), F.col("estimate")) & (F.col("estimate") - F.col("exact") <= EPSILON * F.col("n"))
    return out.select("value", "exact", within.alias("within_eps"), F.lit(capacity).cast("long").alias("counters"))


@query("SELECT l_returnflag, l_linestatus AS value, count(*) AS estimate FROM lineitem GROUP BY 1, 2")
def approx_topk_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k in groups, through a session: an array for each group, opened here."""
    views(spark, sf_dir, "lineitem")
    with Session(spark, hash_seed=SEED) as session:
        got = session.sql(f"SELECT l_returnflag, approx_top_k(l_linestatus, 5, {EPSILON}, {CONFIDENCE}) AS best FROM lineitem GROUP BY l_returnflag")
    return got.select("l_returnflag", F.explode("best").alias("x")).select("l_returnflag", F.col("x.item").alias("value"), F.col("x.count").alias("estimate"))


# quantiles


def _rank_rule(p: float) -> str:
    return f"""WITH c AS (SELECT value AS v, count(*) AS c FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1),
      u AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto, sum(c) OVER () AS n FROM c)
      SELECT min(v) AS q FROM u WHERE upto > ceil({p}::DOUBLE * (n - 1))"""


def _small(p: float):
    return lambda spark, sf_dir: quantiles.exact_rank(table(spark, sf_dir, "events"), F.col("value"), {"q": p})


for _name, _p in quantiles.QUARTILES.items():
    _queries[f"exact_rank_{round(100 * _p)}"], _oracles[f"exact_rank_{round(100 * _p)}"] = _small(_p), _rank_rule(_p)


def _small_rule(p: float) -> str:
    return f"(SELECT n_nationkey::DOUBLE FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET (SELECT ceil({p}::DOUBLE * (count(*) - 1))::BIGINT FROM nation))"


@query(f"SELECT {', '.join(f'{_small_rule(p)} AS {name}' for name, p in quantiles.QUARTILES.items())}")
def approx_quartiles_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches of few values, through a session."""
    views(spark, sf_dir, "nation")
    with Session(spark, hash_seed=SEED) as session:
        return session.sql(f"SELECT {', '.join(f'{name}(n_nationkey, {EPSILON}, {CONFIDENCE}) AS {name}' for name in quantiles.QUARTILES)} FROM nation")


def _ranks(spark: SparkSession, sf_dir: str, estimates_: dict[float, float]) -> DataFrame:
    """p, n and whether each estimate's rank among all prices is within the bound, from one pass."""
    x = F.col("l_extendedprice")
    sums = [F.sum((x < q).cast("long")).alias(f"b{i}") for i, q in enumerate(estimates_.values())] + [F.sum((x <= q).cast("long")).alias(f"u{i}") for i, q in enumerate(estimates_.values())]
    got = table(spark, sf_dir, "lineitem").agg(F.count(x).alias("n"), *sums)
    rows = [F.struct(F.lit(p).alias("p"), F.col("n"), ((F.col(f"b{i}") / F.col("n") - EPSILON <= p) & (F.col(f"u{i}") / F.col("n") + EPSILON >= p)).alias("within_eps")) for i, p in enumerate(estimates_)]
    return got.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


_RANKS = "SELECT p, n, true AS within_eps FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(p), (SELECT count(l_extendedprice) AS n FROM lineitem)"


@query(_RANKS)
def approx_quantile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quartile by a kept sketch, by its rank among all values."""
    views(spark, sf_dir, "lineitem")
    with Session(spark, hash_seed=SEED) as session:
        got = {p: session.value(f"SELECT {name}(l_extendedprice, {EPSILON}, {CONFIDENCE}) FROM lineitem") for name, p in quantiles.QUARTILES.items()}
    return _ranks(spark, sf_dir, got)


@query("SELECT count(DISTINCT l_orderkey) AS exact, true AS within_eps, true AS grouped_within_eps FROM lineitem")
def approx_count_distinct_native_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native HLL that SQL runs, and the same in groups."""
    views(spark, sf_dir, "lineitem")
    call = f"approx_count_distinct(l_orderkey, {EPSILON}, {CONFIDENCE}) AS estimate, count(DISTINCT l_orderkey) AS exact"
    within = F.abs(F.col("estimate") - F.col("exact")) <= EPSILON * F.col("exact")
    with Session(spark, hash_seed=SEED) as session:
        groups = session.sql(f"SELECT l_returnflag, {call} FROM lineitem GROUP BY l_returnflag").agg(F.min(within).alias("grouped_within_eps"))
        whole = session.sql(f"SELECT {call} FROM lineitem").select("exact", within.alias("within_eps"))
    return whole.crossJoin(groups)  # one row each


@query(_RANKS)
def gk_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic summary that takes the sketch's place where it can't be large enough."""
    ps = [0.25, 0.5, 0.75]
    got = table(spark, sf_dir, "lineitem").agg(F.percentile_approx("l_extendedprice", ps, round(1 / EPSILON) + 1).alias("q")).first().q
    return _ranks(spark, sf_dir, dict(zip(ps, map(float, got), strict=True)))


# ingest: a session's own tables


def fresh(spark: SparkSession, schema: str) -> str:
    name = f"_bw_{uuid.uuid4().hex}"  # dropped by its query
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet")
    return name


_HINTED, _FOLLOWING = "(10, 'a'), (20, 'a'), (30, 'b')", "(40, 'c'), (50, 'a')"


@query(f"""SELECT count(DISTINCT user_id)::DOUBLE AS users, count(*) FILTER (WHERE user_id = 'a') AS freq_a, quantile_disc(latency_ms, 0.5)::DOUBLE AS median,
  count(*) AS n FROM (VALUES {_HINTED}, {_FOLLOWING}) v(latency_ms, user_id)""")
def hint_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert with a hint starts sketches, the next one is absorbed; what they say, and how many rows they have seen."""
    name = fresh(spark, "latency_ms double, user_id string")
    with Session(spark, hash_seed=SEED) as session:
        session.sql(f"INSERT APPROX_HINT((latency_ms, user_id), 0.01, 0.9) INTO {name}(latency_ms, user_id) VALUES {_HINTED}")
        session.sql(f"INSERT INTO {name} VALUES {_FOLLOWING}")
        seen = {(e.kind, e.expression): e.n for e in session.registry.entries.values()}
        users = float(round(session.count_distinct(name, "user_id", 0.01, 0.9)))
        row = (users, session.frequency(name, "user_id", "a", 0.01, 0.9), session.sql(f"SELECT approx_median(latency_ms, 0.01, 0.9) FROM {name}").first()[0], seen[(reg.KLL, "latency_ms")])
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([row], "users double, freq_a long, median double, n long")


@query("SELECT count(user_id) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within, true AS cells_equal, true AS one_each FROM events")
def incremental_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's sketches of one half of the events, which the other half's append takes along, against sketches of all."""
    events, name = table(spark, sf_dir, "events"), fresh(spark, "user_id bigint, value double")
    halves = [events.filter(F.pmod("event_id", F.lit(2)) == r).select("user_id", "value") for r in (0, 1)]
    with Session(spark, hash_seed=SEED) as session:
        for half in halves:
            session.append(half, name, st.Hint(("user_id", "value"), EPSILON, CONFIDENCE))
        kept = {(e.kind, e.expression): e for e in session.registry.entries.values()}
        users = session.value(f"SELECT approx_count_distinct(user_id, {EPSILON}, {CONFIDENCE}) FROM {name}")
        median = session.value(f"SELECT approx_median(value, {EPSILON}, {CONFIDENCE}) FROM {name}")
        counted = kept[reg.FREQUENCY, "user_id"]
        whole = reg.build(spark, reg.FREQUENCY, f"FROM {name}", "user_id", counted.params, SEED, "")
        one_each = len(session.registry.entries) == len(kept) == 6  # nothing was built again
    exact = spark.table(name).agg(F.countDistinct("user_id").alias("u"), F.avg((F.col("value") < median).cast("double")).alias("b"), F.avg((F.col("value") <= median).cast("double")).alias("t")).first()
    within = abs(users - exact.u) <= EPSILON * exact.u
    row = (kept[reg.HLL, "user_id"].n, exact.u, within, exact.b - EPSILON <= 0.5 <= exact.t + EPSILON, counted.sketch == whole.sketch and counted.n == whole.n, one_each)
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([row], "n long, users long, users_within boolean, median_within boolean, cells_equal boolean, one_each boolean")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/boundwise-reopen-{uuid.uuid4().hex}"


@query("SELECT event_type AS value, count(*) AS estimate FROM events GROUP BY 1")
def reopen_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session that opens the sketches of a closed one says, without building any."""
    at = folder(spark)
    views(spark, sf_dir, "events")
    ask = f"SELECT approx_top_k(event_type, 5, {EPSILON}, {CONFIDENCE}) FROM events"
    with Session(spark, at, SEED) as first:
        first.sql(ask)
    with Session(spark, at) as second:
        if not second.registry.entries:
            raise ValueError("no sketch was kept")
        return second.sql(ask).select("value", "estimate")


@query("SELECT kind, true AS same, (SELECT count(user_id) FROM events) AS n FROM (VALUES ('freq'), ('hll'), ('kll')) v(kind)")
def reopen_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of sketch: whether a session that opens the stored one says the same, having built none."""
    at = folder(spark)
    views(spark, sf_dir, "events")
    calls = {reg.HLL: "approx_count_distinct(user_id", reg.KLL: "approx_median(user_id", reg.FREQUENCY: "approx_freq(user_id, 1"}
    asks = {kind: f"SELECT {call}, {EPSILON}, {CONFIDENCE}) FROM events" for kind, call in calls.items()}
    with Session(spark, at, SEED) as first:
        said = {kind: first.value(ask) for kind, ask in asks.items()}
    with Session(spark, at) as second:
        kept = {e.kind: e for e in second.registry.entries.values()}
        rows = [(kind, second.value(ask) == said[kind] and len(second.registry.entries) == 3, kept[kind].n) for kind, ask in asks.items()]
    return spark.createDataFrame(rows, "kind string, same boolean, n long")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within
  FROM events GROUP BY 1, 2""")
def window_sketch_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed sketches by event type, read: whether what they say of the users is within the bounds, by exact counts and ranks."""
    events = table(spark, sf_dir, "events")
    got = estimates(windowed(events, "ts", "user_id", "1 day", "1 day", EPSILON, CONFIDENCE, by=["event_type"]), 0.5)
    day = F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("start")
    rows = events.select(day, "event_type", "user_id").join(got.select("start", "event_type", "n", "distinct", "q50"), ["start", "event_type"])
    user = F.col("user_id")
    out = rows.groupBy("start", "event_type", "n", "distinct").agg(F.countDistinct(user).alias("users"), F.avg((user < F.col("q50")).cast("double")).alias("b"), F.avg((user <= F.col("q50")).cast("double")).alias("t"))
    users_within = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(0.5), EPSILON * F.col("users"))
    median_within = (F.col("b") - EPSILON <= 0.5) & (F.col("t") + EPSILON >= 0.5)
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "users", users_within.alias("users_within"), median_within.alias("median_within"))
