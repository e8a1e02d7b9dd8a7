import io
import uuid

import pytest
from boundwise import shell
from boundwise.errors import MisuseError, QueryError
from boundwise.plans.statements import Hint
from boundwise.session import Session
from boundwise.sources import registry as reg
from boundwise.streaming import estimates, maintain, windowed
from pyspark.sql import functions as F


@pytest.fixture
def table(spark):
    names = []

    def make(schema, rows=()):
        name = f"t_{uuid.uuid4().hex[:12]}"
        names.append(name)
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet")
        if rows:
            spark.createDataFrame(list(rows), schema).write.insertInto(name)
        return name

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def one(session, sql):
    return session.sql(sql).first()[0]


def test_functions_follow_inserts(spark, table):
    s, t = Session(spark, hash_seed=5), table("user_id string", [("a",), ("b",), ("a",), ("c",)])
    ask = f"SELECT approx_count_distinct(user_id, 0.05, 0.9) FROM {t}"
    assert one(s, ask) == 3.0 and s.memory_bytes() > 0
    s.sql(f"INSERT INTO {t} VALUES ('d'), ('a')")
    (entry,) = [e for e in s.registry.entries.values() if e.kind == reg.HLL]
    assert entry.n == 6  # absorbed, not built again
    assert one(s, ask) == 4.0


def test_quartiles_share_a_sketch_and_frequencies_another(spark, table):
    s, t = Session(spark, hash_seed=5), table("v double", [(float(x),) for x in range(1, 6)])
    got = [one(s, f"SELECT {f}(v, 0.05, 0.9) FROM {t}") for f in ("approx_25", "approx_median", "approx_75")]
    assert got[1] == 3.0 and got == sorted(got) and len(s.registry.entries) == 1
    assert one(s, f"SELECT approx_freq(v, '3.0', 0.05, 0.9) FROM {t}") == 1
    assert s.sql(f"SELECT approx_top_k(v, 2, 0.05, 0.9) FROM {t}").collect()[0].value == 1.0
    assert len(s.registry.entries) == 2


def test_top_k_and_columns(spark, table):
    s, t = Session(spark, hash_seed=5), table("user_id string", [("hot",)] * 3 + [("warm",)] * 2 + [("cold",)])
    got = s.sql(f"SELECT approx_top_k(user_id, 2, 0.05, 0.9) FROM {t}")
    assert got.columns == ["value", "estimate", "error"] and [tuple(r) for r in got.collect()] == [("hot", 3, 0), ("warm", 2, 0)]
    assert s.sql(f"SELECT approx_freq(user_id, 'hot', 0.05, 0.9) FROM {t}").columns == ["approx_freq"]


def test_a_more_accurate_sketch_is_used_again(spark, table):
    s, t = Session(spark, hash_seed=5), table("v long", [(x,) for x in range(100)])
    one(s, f"SELECT approx_count_distinct(v, 0.02, 0.95) FROM {t}")
    one(s, f"select  APPROX_COUNT_DISTINCT(v, 0.1, 0.8)  from {t} ; ")
    assert len(s.registry.entries) == 1


def test_conditions_and_expressions_have_their_own_sketches(spark, table):
    s, t = Session(spark, hash_seed=5), table("v long", [(x,) for x in range(100)])
    assert abs(one(s, f"SELECT approx_median(v, 0.05, 0.9) FROM {t}") - 50) <= 5
    assert abs(one(s, f"SELECT approx_median(v, 0.05, 0.9) FROM {t} WHERE v < 10") - 5) <= 1
    assert abs(one(s, f"SELECT approx_median(v + 1000, 0.05, 0.9) FROM {t}") - 1050) <= 5
    s.sql(f"INSERT INTO {t} VALUES (5), (500)")
    assert {e.n for e in s.registry.entries.values()} == {102, 11}


def test_other_changes_make_sketches_stale(spark, table):
    s, t, u = Session(spark, hash_seed=5), table("v long", [(1,), (2,)]), table("v long", [(1,)])
    joined = f"SELECT approx_count_distinct(a.v, 0.05, 0.9) FROM {t} a JOIN {u} b ON a.v >= b.v"
    assert one(s, joined) == 2.0 and one(s, f"SELECT approx_count_distinct(v, 0.05, 0.9) FROM {u}") == 1.0
    s.sql(f"INSERT INTO {u} SELECT 2")  # not of values: not absorbed
    assert s.registry.entries == {}
    s.sql(f"TRUNCATE TABLE {u}; INSERT INTO {u} VALUES (2)")
    assert one(s, joined) == 1.0
    spark.createDataFrame([(7,)], "v long").write.insertInto(t)  # behind the session's back
    assert one(s, joined) == 2.0


def test_signed_values_and_nulls_are_absorbed(spark, table):
    s, t = Session(spark, hash_seed=5), table("v double, w string")
    s.sql(f"INSERT INTO {t}(v) VALUES (-1.5), (2e3), (NULL)")
    assert {(e.kind, e.expression): e.n for e in s.registry.entries.values()} == {("hll", "v"): 2, ("kll", "v"): 2, ("freq", "v"): 2}
    assert one(s, f"SELECT count(*) FROM {t} WHERE w IS NULL") == 3


def test_hint_and_reopen(spark, table, tmp_path):
    t, root = table("latency_ms double, user_id string"), str(tmp_path / "sketches")
    with Session(spark, root, hash_seed=11) as s:
        s.sql(f"INSERT APPROX_HINT((latency_ms, user_id), 0.01, 0.95) INTO {t}(latency_ms, user_id) VALUES (10,'a'),(20,'a'),(30,'b'),(40,'c'),(50,'a')")
        asks = [f"SELECT approx_median(latency_ms, 0.01, 0.95) FROM {t}", f"SELECT approx_count_distinct(user_id, 0.01, 0.95) FROM {t}", f"SELECT approx_freq(user_id, 'a', 0.01, 0.95) FROM {t}"]
        first = [one(s, q) for q in asks]
        assert first == [30.0, 3.0, 3]
    again = Session(spark, root)
    assert again.seed == 11
    kept = set(again.registry.entries)
    assert [one(again, q) for q in asks] == first and set(again.registry.entries) == kept
    again.sql(f"INSERT INTO {t} VALUES (60, 'd')")
    assert one(Session(spark, root), asks[1]) == 4.0


def test_an_insert_into_a_table_with_rows_starts_no_partial_sketch(spark, table):
    s, t = Session(spark, hash_seed=5), table("v long", [(x,) for x in range(50)])
    s.sql(f"INSERT APPROX_HINT((v), 0.05, 0.9) INTO {t}(v) VALUES (100)")
    assert s.registry.entries == {} and one(s, f"SELECT approx_count_distinct(v, 0.05, 0.9) FROM {t}") == 51.0


def test_groups_and_several_calls(spark, table):
    s, t = Session(spark, hash_seed=5), table("g string, v long", [("a", 1), ("a", 2), ("b", 3)])
    got = s.sql(f"SELECT g, approx_count_distinct(v, 0.05, 0.9) AS n, approx_median(v, 0.05, 0.9), approx_freq(v, 3, 0.05, 0.9) AS f FROM {t} GROUP BY g ORDER BY g").collect()
    assert [(r.g, r.n, r.f) for r in got] == [("a", 2.0, 0), ("b", 1.0, 1)] and got[1].approx_median == 3.0


def test_errors_and_callback(spark, table):
    s, t = Session(spark, hash_seed=5), table("v long", [(1,), (2,)])
    with pytest.raises(QueryError):
        s.sql("SELECT * FROM nowhere_at_all")
    assert "nowhere_at_all" in s.last_error
    seen = []
    s.exec(f"SELECT v, CAST(NULL AS string) AS n, 0.5D AS d FROM {t} ORDER BY v", lambda values, names: seen.append((values, names)))
    assert seen[0] == (["1", None, "0.500000"], ["v", "n", "d"]) and s.last_error == "not an error"
    with pytest.raises(QueryError, match="query aborted by callback"):
        s.exec(f"SELECT v FROM {t}", lambda values, names: 1)
    s.close()
    s.close()
    with pytest.raises(MisuseError):
        s.sql("SELECT 1")


def test_merge_needs_like_sketches(spark):
    a = reg.Entry(reg.HLL, "from t", "v", {"p": 10}, 1, "s", 1, "long")
    with pytest.raises(ValueError):
        reg.merge(spark, a, reg.Entry(reg.HLL, "from t", "v", {"p": 10}, 2, "s", 1, "long"), "s")


def test_shell(spark, table):
    t, out = table("v long", [(1,), (2,)]), io.StringIO()
    shell.loop(Session(spark, hash_seed=5), [".help", "", f"SELECT approx_count_distinct(v, 0.05, 0.9) FROM {t}", "SELECT approx_25(v)", ".memory", ".quit", "SELECT 1"], out)
    lines = out.getvalue().splitlines()
    assert lines[1] == "approx_count_distinct=2.000000" and lines[2].startswith("error: approx_25 expects") and len(lines) == 4


def test_stream_keeps_table_and_sketches(spark, table, tmp_path):
    source, t, s = tmp_path / "in", table("v long"), Session(spark, hash_seed=5)
    hint, checkpoint = Hint(("v",), 0.05, 0.9), str(tmp_path / "cp")
    for low in (0, 500):
        spark.range(low, low + 1000).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(str(source))
        q = maintain(s, spark.readStream.schema("v long").parquet(str(source)), t, checkpoint, hint)
        assert q.awaitTermination(120)
    assert spark.table(t).count() == 2000
    hlls = [e for e in s.registry.entries.values() if e.kind == reg.HLL]
    assert [e.n for e in hlls] == [2000]
    assert abs(one(s, f"SELECT approx_count_distinct(v, 0.05, 0.9) FROM {t}") - 1500) < 75
    assert not s.append_batch(checkpoint, 0, spark.range(1).toDF("v"), t)


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "user_id", "7 days", "365 days", 0.05, 0.9).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.start, r.n, r.distinct) for r in estimates(spark.table("weeks"), 0.5).collect()}
    want = {(r.start, r.n, r.distinct) for r in estimates(windowed(events, "ts", "user_id", "7 days", "365 days", 0.05, 0.9), 0.5).collect()}
    assert got == want and len(got) > 1


def test_values_are_trusted_for_a_while(spark, table):
    t = table("v long", [(1,), (2,)])
    ask = f"SELECT approx_count_distinct(v, 0.05, 0.9) FROM {t}"
    careful, trusting = Session(spark, hash_seed=5), Session(spark, hash_seed=5, recheck=600)
    assert careful.value(ask) == trusting.value(ask) == 2.0
    spark.createDataFrame([(7,)], "v long").write.insertInto(t)  # behind the sessions' backs
    assert careful.value(ask) == 3.0 and trusting.value(ask) == 2.0
    trusting.sql(f"INSERT INTO {t} VALUES (8)")
    assert trusting.value(ask) == 4.0
    assert trusting.value(f"SELECT approx_top_k(v, 1, 0.05, 0.9) FROM {t}") == [("1", 1, 0)]
    with pytest.raises(QueryError):
        careful.value("SELECT 1")


def test_top_k_in_groups_and_beside_other_items(spark, table):
    t = table("g long, v string", [(i % 2, "hot" if i % 3 else f"x{i}") for i in range(60)])
    with Session(spark, hash_seed=5) as s:
        got = s.sql(f"SELECT g, approx_top_k(v, 1, 0.05, 0.9) AS best, count(*) AS n FROM {t} GROUP BY g ORDER BY g").collect()
        assert [(r.g, [tuple(x) for x in r.best], r.n) for r in got] == [(0, [("hot", 20)], 30), (1, [("hot", 20)], 30)]
        with pytest.raises(QueryError, match="no summary"):
            s.sql(f"SELECT g, approx_top_k(v, 1, 0.0000001, 0.9) FROM {t} GROUP BY g")


def test_answers_have_the_name_that_was_asked_for(spark, table):
    s, t = Session(spark, hash_seed=5), table("v long", [(1,), (2,)])
    for name in ("AS n", "n", "as `n`"):
        assert s.sql(f"SELECT approx_count_distinct(v, 0.05, 0.9) {name} FROM {t}").columns == ["n"]
    assert s.sql(f"SELECT approx_median(v, 0.05, 0.9) FROM {t}").columns == ["approx_median"] and len(s.registry.entries) == 2
