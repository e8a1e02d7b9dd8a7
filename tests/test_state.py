import uuid

import pytest
from boundwise.session import Session
from boundwise.sources.state import source_state

ASK = "SELECT approx_count_distinct(id, 0.01, 0.99) FROM {}"


def said(session, view):
    return round(session.sql(ASK.format(view)).first()[0])


@pytest.fixture
def view(spark):
    name = f"v_{uuid.uuid4().hex[:10]}"
    yield name
    spark.catalog.dropTempView(name)


def test_a_view_replaced_outside_the_session(spark, view, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    rows.createOrReplaceTempView(view)
    with Session(spark, hash_seed=5) as s:
        assert said(s, view) == 100
        rows.filter("id < 10").createOrReplaceTempView(view)
        assert said(s, view) == 10
        assert s.value(ASK.format(view)) == pytest.approx(10, abs=0.5)


def test_a_view_replaced_through_the_session(spark, view, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView(f"{view}_all")
    with Session(spark, hash_seed=5) as s:
        s.sql(f"CREATE OR REPLACE TEMP VIEW {view} AS SELECT * FROM {view}_all")
        assert said(s, view) == 100
        s.sql(f"CREATE OR REPLACE TEMP VIEW {view} AS SELECT * FROM {view}_all WHERE id < 10")
        assert not s.registry.entries and said(s, view) == 10
    spark.catalog.dropTempView(f"{view}_all")


def test_a_file_rewritten_under_its_name(spark, view, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    file = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": list(range(20))}), file)
    spark.read.parquet(file).createOrReplaceTempView(view)
    with Session(spark, hash_seed=5) as s:
        assert said(s, view) == 20
        pq.write_table(pa.table({"id": list(range(60))}), file)
        assert said(s, view) == 60


def test_views_over_literals(spark, view):
    with Session(spark, hash_seed=5) as s:
        for n in (3, 5):
            spark.createDataFrame([(i,) for i in range(n)], "id long").createOrReplaceTempView(view)
            assert said(s, view) == n


def test_what_changes_by_itself_is_not_kept(spark, view, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView(view)
    for source in ("WHERE rand() < 0.5", "WHERE id < unix_timestamp()", f"WHERE id IN (SELECT id FROM {view})", f"WHERE id > (SELECT min(id) FROM {view})", "TABLESAMPLE (10 PERCENT)"):
        assert source_state(spark.sql(f"SELECT * FROM {view} {source}"), 0) is None, source
    with Session(spark, hash_seed=5) as s:
        assert said(s, f"{view} WHERE id > (SELECT min(id) FROM {view})") == 99 and not s.registry.entries
        assert s.sql(f"SELECT approx_top_k(id, 2, 0.05, 0.9) FROM {view} WHERE id < unix_timestamp()").count() == 2 and not s.registry.entries


def test_states_do_not_depend_on_the_session(spark, view, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    states = []
    for session in (spark, spark.newSession()):
        session.read.parquet(f"{tmp_path}/t").createOrReplaceTempView(view)
        states.append(source_state(session.sql(f"SELECT * FROM {view} WHERE id > 3"), 0))
    assert states[0] == states[1] and states[0].startswith("files:")
