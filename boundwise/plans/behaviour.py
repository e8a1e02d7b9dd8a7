"""Registered queries that run a session's own behaviour: sizes, messages, callbacks, the shell, what is kept, dropped and saved."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bounds, shell
from ..errors import MisuseError, QueryError
from ..session import Session
from ..sources import registry as reg
from ..streaming import maintain
from . import statements as st
from .catalogue import CONFIDENCE, EPSILON, SEED, folder, fresh, query, table, views

_EPSILONS, _CONFIDENCES = (0.1, 0.05, 0.02, 0.01), (0.8, 0.9, 0.95, 0.99, 0.999)


def _values(rows: list[tuple]) -> str:
    def text(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x).lower()

    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)


@query(f"""WITH a AS (SELECT e, c, greatest(1 - c, 1e-12::DOUBLE) AS d FROM (VALUES {_values([(e,) for e in _EPSILONS])}) x(e), (VALUES {_values([(c,) for c in _CONFIDENCES])}) y(c))
  SELECT e AS epsilon, c AS confidence, greatest(4, least(24, ceil(log2(pow(1.04::DOUBLE / (e * sqrt(greatest(1 - c, 2.220446049250313e-16::DOUBLE))), 2)))))::INT AS precision,
         least(1048576, greatest(32, ceil(2 / e * sqrt(ln(2 / d)))))::INT AS k, least(16777216, greatest(16, ceil(exp(1.0::DOUBLE) / e)))::INT AS width,
         least(64, greatest(2, ceil(ln(1 / d))))::INT AS depth, greatest(10, ceil(1 / e))::INT AS capacity FROM a""")
def sketch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bounds ask of each kind of sketch."""
    rows = []
    for e in _EPSILONS:
        for c in _CONFIDENCES:
            dims = bounds.cms_dims(e, c)
            rows.append((e, c, bounds.hll_precision(e, c).value, bounds.kll_capacity(e, c).value, dims.width, dims.depth, bounds.topk_capacity(10, e).value))
    return spark.createDataFrame(rows, "epsilon double, confidence double, precision int, k int, width int, depth int, capacity int")


#: Messages that callers rely on. Fixed values.
_MESSAGES = [
    ("approx_count_distinct(n_name)", "approx_count_distinct expects exactly 3 arguments: expression, epsilon, confidence"),
    ("approx_freq(n_name, 0.1, 0.9)", "approx_freq expects exactly 4 arguments"),
    ("approx_median(, 0.1, 0.9)", "approx_median expression argument cannot be empty"),
    ("approx_freq(n_name, a + b, 0.1, 0.9)", "approx_freq target value must be a single string, number, or identifier literal"),
    ("approx_top_k(n_name, 0, 0.1, 0.9)", "approx_top_k k must be a positive integer literal"),
    ("approx_25(n_name, 0, 0.9)", "approx_25 epsilon must be a number in (0, 1]"),
    ("approx_25(n_name, 0.1 + 0.1, 0.9)", "approx_25 epsilon must be a single numeric literal"),
    ("approx_75(n_name, 0.1, 2)", "approx_75 confidence must be a number in (0, 1]"),
    ("approx_75(n_name, 0.1, -1)", "approx_75 confidence must be a single numeric literal"),
    ("approx_75(n_name, 0.1, 0.9", "approx_75 is missing a closing ')'"),
    ("approx_join_size(n_name, 0.1, 0.9)", "approx_join_size is not a supported approximate function yet"),
]


@query(f"SELECT call, message, true AS remembered, true AS usable FROM (VALUES {_values(_MESSAGES)}) v(call, message)")
def planner_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session says to malformed calls, keeps as its last error, and that it goes on behind them."""
    views(spark, sf_dir, "nation")
    rows = []
    with Session(spark, hash_seed=SEED) as session:
        for call, _ in _MESSAGES:
            try:
                said = session.sql(f"SELECT {call} FROM nation") and "no error"
            except QueryError as e:
                said = str(e)
            remembered = session.last_error == said
            usable = session.sql("SELECT count(*) AS n FROM nation").first().n > 0 and session.last_error == "not an error"
            rows.append((call, said, remembered, usable))
    return spark.createDataFrame(rows, "call string, message string, remembered boolean, usable boolean")


@query("""SELECT count(*) FILTER (WHERE event_type = 'click')::BIGINT AS clicks, count(*)::BIGINT AS n, 0::BIGINT AS quoted, count(DISTINCT event_type)::DOUBLE AS types FROM events""")
def quotes_and_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls beside strings, names and comments that look like calls, semicolons or quotes."""
    views(spark, sf_dir, "events")
    with Session(spark, hash_seed=SEED) as session:
        return session.sql(f"""-- approx_median(x); it's a comment
          SELECT /* approx_top_k(' */ approx_freq(event_type, 'click', {EPSILON}, {CONFIDENCE}) AS clicks, count(*) AS `n`,
                 approx_freq(event_type, 'approx_25(;''', {EPSILON}, {CONFIDENCE}) AS quoted, APPROX_Count_Distinct ( "event_type" || event_type , 0.05, .9) AS types FROM events;""")


@query("SELECT event_type, count(*)::VARCHAR AS n, true AS stopped FROM events GROUP BY event_type ORDER BY event_type LIMIT 3")
def callback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a callback got as texts, until it asked to stop."""
    views(spark, sf_dir, "events")
    rows: list[tuple[str, str]] = []

    def take(values: list[str | None], names: list[str]) -> int:
        rows.append(tuple(values))
        return int(len(rows) == 3)

    with Session(spark, hash_seed=SEED) as session:
        try:
            session.exec("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type", take)
            stopped = False
        except QueryError as e:
            stopped = str(e) == "query aborted by callback"
    return spark.createDataFrame([(*r, stopped) for r in rows], "event_type string, n string, stopped boolean")


@query("""SELECT 1 AS nth, 'n=' || count(*) || ' | least=' || min(n_name) AS line FROM nation UNION ALL SELECT 2, 'error: approx_25 epsilon must be a number in (0, 1]'
  UNION ALL SELECT 3, 'approx_count_distinct=' || count(DISTINCT n_regionkey) || '.000000' FROM nation UNION ALL SELECT 4, 'n= | m=1'""")
def shell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shell prints to some lines, and nothing behind .quit."""
    views(spark, sf_dir, "nation")
    said = io.StringIO()
    lines = [
        "SELECT count(*) AS n, min(n_name) AS least FROM nation", "", "SELECT approx_25(n_name, 0, 0.9) FROM nation", f"SELECT approx_count_distinct(n_regionkey, {EPSILON}, {CONFIDENCE}) FROM nation", "SELECT NULL AS n, 1 AS m",
        ".quit", "SELECT 1",
    ]
    with Session(spark, hash_seed=SEED) as session:
        shell.loop(session, lines, said)
    return spark.createDataFrame(list(enumerate(said.getvalue().splitlines(), 1)), "nth int, line string")


@query("""SELECT 'all' AS view, count(DISTINCT event_type)::DOUBLE AS types FROM events UNION ALL SELECT 'outside', 1 UNION ALL SELECT 'through', 2
  UNION ALL SELECT 'file', count(DISTINCT n_name)::DOUBLE FROM nation UNION ALL SELECT 'rewritten', count(DISTINCT n_name) FROM nation WHERE n_regionkey = 0""")
def replaced_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kept sketches say once a view is another one, by the session or behind its back, or its file was written anew."""
    events, nation, at = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"), folder(spark)
    events.createOrReplaceTempView("events")
    ask = f"SELECT approx_count_distinct({{}}, {EPSILON}, {CONFIDENCE}) AS n FROM _replaced"
    rows = []
    with Session(spark, hash_seed=SEED) as session:

        def note(name: str, column: str = "event_type") -> None:
            rows.append((name, float(round(session.sql(ask.format(column)).first().n))))

        events.createOrReplaceTempView("_replaced")
        note("all")
        events.filter("event_type = 'click'").createOrReplaceTempView("_replaced")
        note("outside")
        types = ", ".join(f"'{r[0]}'" for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect())
        session.sql(f"CREATE OR REPLACE TEMP VIEW _replaced AS SELECT * FROM events WHERE event_type IN ({types})")
        note("through")
        for name, part in (("file", nation), ("rewritten", nation.filter("n_regionkey = 0"))):
            part.coalesce(1).write.mode("overwrite").parquet(at)
            spark.read.parquet(at).createOrReplaceTempView("_replaced")
            note(name, "n_name")
    spark.catalog.dropTempView("_replaced")
    return spark.createDataFrame(rows, "view string, types double")


@query("SELECT * FROM (VALUES ('accurate', 1), ('looser', 1), ('another expression', 2), ('a condition', 3), ('a change of the table', 0), ('asked again', 1), ('closed', 0)) v(step, sketches)")
def kept_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sketches a session keeps: one serves what is asked less accurately; a change that it can't follow drops them."""
    name = fresh(spark, "v bigint")
    spark.range(100).selectExpr("id AS v").write.insertInto(name)
    rows = []
    session = Session(spark, hash_seed=SEED)

    def note(step: str, sql: str) -> None:
        out = session.sql(sql)
        if out is not None and sql.startswith("SELECT"):
            out.collect()
        rows.append((step, len(session.registry.entries)))

    note("accurate", f"SELECT approx_count_distinct(v, 0.02, 0.95) FROM {name}")
    note("looser", f"select approx_count_distinct( v, 0.1, 0.8)  from {name};".replace("select", "SELECT"))
    note("another expression", f"SELECT approx_count_distinct(v + 1, 0.1, 0.8) FROM {name}")
    note("a condition", f"SELECT approx_median(v, 0.1, 0.8) FROM {name} WHERE v < 50")
    note("a change of the table", f"INSERT OVERWRITE {name} SELECT id FROM range(5)")
    note("asked again", f"SELECT approx_count_distinct(v, 0.02, 0.95) FROM {name}")
    if not session.memory_bytes():
        raise ValueError("a kept sketch takes memory")
    session.close()
    session.close()
    try:
        session.sql("SELECT 1")
    except MisuseError:
        rows.append(("closed", len(session.registry.entries)))
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "step string, sketches int")


_FIRST, _SECOND = "(10, 'a'), (20, 'a'), (30, 'b')", "(40, 'c'), (50, 'a')"


@query(f"""SELECT count(DISTINCT u)::DOUBLE AS users, count(*) FILTER (WHERE u = 'a')::BIGINT AS freq_a, quantile_disc(x, 0.5)::DOUBLE AS median, count(*)::BIGINT AS n, 5 AS sketches, {SEED}::BIGINT AS seed
  FROM (VALUES {_FIRST}, {_SECOND}) v(x, u)""")
def saved_after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inserts have saved, as a session says that opens it later."""
    at, name = folder(spark), fresh(spark, "x double, u string")
    with Session(spark, at, SEED) as first:
        first.sql(f"INSERT APPROX_HINT((x, u), 0.01, 0.9) INTO {name}(x, u) VALUES {_FIRST}")
        first.sql(f"INSERT INTO {name} VALUES {_SECOND}")
    with Session(spark, at) as second:
        kept = {(e.kind, e.expression): e.n for e in second.registry.entries.values()}
        said = [second.value(f"SELECT {call}, 0.01, 0.9) FROM {name}") for call in ("approx_count_distinct(u", "approx_freq(u, 'a'", "approx_median(x")]
        row = (float(round(said[0])), said[1], said[2], kept[reg.KLL, "x"], len(kept), second.seed)  # no quantiles of texts
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([row], "users double, freq_a long, median double, n long, sketches int, seed long")


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, true AS users_within, true AS follows FROM events")
def stream_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with sketches that a stream of the events keeps up to date, in two runs of the query."""
    events, at, name = table(spark, sf_dir, "events").select("event_id", "user_id"), folder(spark), fresh(spark, "event_id bigint, user_id bigint")
    with Session(spark, hash_seed=SEED) as session:
        for part in (0, 1):
            events.filter(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(f"{at}/in")
            stream = spark.readStream.schema("event_id bigint, user_id bigint").parquet(f"{at}/in")
            maintain(session, stream, name, f"{at}/checkpoint", st.Hint(("user_id",), EPSILON, CONFIDENCE)).awaitTermination()
        users = session.value(f"SELECT approx_count_distinct(user_id, {EPSILON}, {CONFIDENCE}) FROM {name}")
        seen = {e.n for e in session.registry.entries.values() if e.expression == "user_id"}
    exact = spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("known"), F.countDistinct("user_id").alias("u")).first()
    row = (exact.n, exact.u, abs(users - exact.u) <= EPSILON * exact.u, seen == {exact.known})
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([row], "n long, users long, users_within boolean, follows boolean")
