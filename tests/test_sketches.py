import math
import random

import numpy as np
import pytest
from boundwise import bounds
from boundwise.operators import frequency, hll, quantiles
from boundwise.operators.frequency import Summary
from boundwise.plans.calls import rewritten
from pyspark.sql import functions as F


def test_hll_estimates_and_merges(spark):
    p = bounds.hll_precision(0.05, 0.9).value
    rows = spark.range(50_000).select((F.col("id") % 10_000).alias("u"))
    got = hll.estimate(hll.registers(rows, F.col("u"), p, seed=1), p).first().estimate
    assert abs(got - 10_000) < 500
    left, right = (hll.registers(spark.range(a, a + 5000), F.col("id"), p, seed=1) for a in (0, 5000))
    both = hll.estimate(hll.merged(left.unionByName(right)), p).first().estimate
    assert both == hll.estimate(hll.registers(spark.range(10_000), F.col("id"), p, seed=1), p).first().estimate


def test_hll_empty_and_null(spark):
    rows = spark.createDataFrame([(None,)], "v string")
    assert hll.estimate(hll.registers(rows, F.col("v"), 10), 10).first().estimate == 0.0
    rows = spark.createDataFrame([("",), (None,), ("a",)], "v string")
    rows.createOrReplaceTempView("blanks")
    assert spark.sql(rewritten("SELECT approx_count_distinct(v, 0.05, 0.9) AS n FROM blanks")).first().n == 2.0
    assert spark.sql(rewritten("SELECT approx_count_distinct(v, 0.05, 0.9) AS n FROM blanks WHERE false")).first().n == 0.0


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_registers_do_not_depend_on_partitions(spark, parts):
    rows = spark.range(3000).repartition(parts)
    got = {(r.idx, r.rho) for r in hll.registers(rows, F.col("id"), 8, seed=3, portable=True).collect()}
    want = {(r.idx, r.rho) for r in hll.registers(spark.range(3000).coalesce(1), F.col("id"), 8, seed=3, portable=True).collect()}
    assert got == want


def test_hll_holds_its_bounds(spark):
    epsilon, confidence, n, seeds = 0.1, 0.8, 4000, 100
    p = bounds.hll_precision(epsilon, confidence).value
    rows = spark.range(n).crossJoin(spark.range(seeds).withColumnRenamed("id", "s"))
    value = F.concat_ws("-", "s", "id")
    got = hll.estimate(hll.registers(rows.select("s", value.alias("v")), F.col("v"), p, ["s"]), p, ["s"]).collect()
    assert sum(abs(r.estimate - n) <= epsilon * n for r in got) >= confidence * seeds


def test_beyond_native_precision_the_count_is_exact(spark):
    spark.range(777).createOrReplaceTempView("ids")
    assert spark.sql(rewritten("SELECT approx_count_distinct(id, 0.01, 0.999) AS n FROM ids")).first().n == 777.0


def test_quantiles(spark):
    spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)] + [(float("nan"),), (float("inf"),), (None,)], "v double").createOrReplaceTempView("latencies")
    r = spark.sql(rewritten("SELECT approx_median(v, 0.05, 0.9) AS m FROM latencies")).first()
    assert r.m == 30.0
    assert spark.sql(rewritten("SELECT approx_median(v, 0.05, 0.9) AS m FROM latencies WHERE v < 0")).first().m == 0.0
    rows = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "v double")
    got = quantiles.exact_rank(rows, F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert (got.a, got.b, got.c) == (20.0, 30.0, 40.0)
    assert quantiles.exact_rank(rows.filter("v > 99"), F.col("v"), {"a": 0.5}).first().a == 0.0


def test_quantile_error_over_text_and_seeds(spark):
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("v"))
    k = bounds.kll_capacity(0.05, 0.9).value
    miss = 0
    for parts in (1, 8):
        for _ in range(10):
            got = rows.repartition(parts).agg(quantiles.sketch(F.col("v"), k).alias("s")).select(F.expr("kll_sketch_get_quantile_double(s, 0.5D)").alias("q")).first().q
            miss += abs(got - 5000) > 500
    assert miss <= 2


def test_cms_never_underestimates(spark):
    rows = spark.createDataFrame([("a",)] * 100 + [("b",)] * 30 + [(None,)], "v string")
    w, d, _ = bounds.cms_dims(0.01, 0.99)
    cells = frequency.cells(rows, F.col("v"), w, d, seed=42)
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], "v string")
    got = {r.v: r.estimate for r in frequency.estimates(cells, asked, "v", w, d, seed=42).collect()}
    assert got["a"] >= 100 and got["b"] >= 30 and got["zz"] <= 30
    rows.createOrReplaceTempView("letters")
    assert spark.sql(rewritten("SELECT approx_freq(v, 'a', 0.01, 0.99) AS n FROM letters")).first().n >= 100
    assert spark.sql(rewritten("SELECT approx_freq(v, 'a', 0.01, 0.99) AS n FROM letters WHERE v IS NULL")).first().n == 0


def _skewed(n, seed):
    rng = random.Random(seed)
    return [("hot-0", "hot-1", "hot-2")[k] if (k := rng.choices(range(4), (20, 12, 8, 60))[0]) < 3 else f"user-{rng.randrange(1000)}" for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_top_k_holds_its_bounds(spark, parts):
    values, epsilon = _skewed(20_000, parts), 0.02
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)
    got = frequency.top_k(frequency.summary(rows, F.col("v"), bounds.topk_capacity(3, epsilon).value), 3).collect()
    assert [r.value for r in got] == ["hot-0", "hot-1", "hot-2"]
    for r in got:
        true = values.count(r.value)
        assert r.estimate - r.error <= true <= r.estimate and r.error <= epsilon * len(values)


def test_top_k_without_values(spark):
    rows = spark.createDataFrame([(None,)], "v long")
    assert frequency.top_k(frequency.summary(rows, F.col("v"), 10), 3).collect() == []


def test_summaries_merge():
    values = _skewed(5000, 1)
    whole, parts = Summary(50), [Summary(50) for _ in range(5)]
    for i, v in enumerate(values):
        whole.add({v: 1})
        parts[i % 5].add({v: 1})
    for p in parts[1:]:
        parts[0].merge(p)
    for s in (whole, parts[0]):
        assert len(s.counters) <= 50 and s.lost <= len(values) / 51 * 2
        for v, estimate, error in s.top(50):
            assert estimate - error <= values.count(v) <= estimate


def test_relative_error_of_precision():
    assert math.isclose(hll.relative_error(10), 0.0325)


def test_one_pass_gives_cells_and_summary(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"v{int(x)}" if x < 300 else None,) for x in rng.zipf(1.5, 3000)], "v string").repartition(5)
    both = frequency.sketched(rows, F.col("v"), 40, 3, 12, 7)
    cells = sorted((r.nth, r.bucket, r.counter) for r in both.filter("nth is not null").collect())
    assert cells == sorted(map(tuple, frequency.cells(rows, F.col("v"), 40, 3, seed=7).select("row", "bucket", "c").collect()))
    true = {r.v: r.n for r in rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("n")).collect()}
    best = frequency.top_k(both.filter("nth is null").drop("nth", "bucket"), 5).collect()
    assert len(best) == 5 and all(r.estimate - r.error <= true[r.value] <= r.estimate for r in best)


def test_summaries_keep_as_many_values_as_they_can():
    s = frequency.Summary(5)
    s.add({f"v{i:02}": 1 for i in range(30)})
    assert len(s.top(5)) == 5 and all(n - e <= 1 <= n for _, n, e in s.top(5))


def test_join_sizes_are_never_too_small(spark):
    rng = np.random.default_rng(4)
    a, b = (spark.createDataFrame([(int(x),) for x in rng.integers(0, 200, n)], "v long") for n in (900, 500))
    exact = a.join(b, "v").count()
    size = lambda x, y, w: frequency.join_size(frequency.cells(x, F.col("v"), w, 4, seed=3), frequency.cells(y, F.col("v"), w, 4, seed=3)).first().estimate
    assert size(a, b, 50) >= size(a, b, 1 << 20) >= exact and size(a, b, 1 << 20) == exact
    assert size(a, b.filter("v < 0"), 50) == 0 and size(a.filter("v < 0"), b, 50) == 0


def test_exact_ranks_of_odd_values(spark):
    rows = [(float(x),) for x in [3, 3, 3, 1, 2, 9, 9]] + [(None,), (float("nan"),), (float("inf"),)]
    got = quantiles.exact_rank(spark.createDataFrame(rows, "v double"), F.col("v"), {"a": 0.0, "b": 0.5, "c": 1.0}).first()
    assert tuple(got) == (1.0, 3.0, 9.0)
    empty = quantiles.exact_rank(spark.createDataFrame([], "v double"), F.col("v"), {"a": 0.5}).collect()
    assert [tuple(r) for r in empty] == [(0.0,)]
    rng = np.random.default_rng(5)
    values = sorted(rng.integers(0, 3000, 5000).astype(float).tolist())
    got = quantiles.exact_rank(spark.createDataFrame([(x,) for x in values], "v double"), F.col("v"), {"a": 0.1, "b": 0.73}).first()
    assert tuple(got) == tuple(values[int(np.ceil(p * 4999))] for p in (0.1, 0.73))
