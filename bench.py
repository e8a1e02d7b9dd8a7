"""Times the headline queries and prints one line of JSON.

``build_*`` makes a sketch from the table, ``exact_*`` is what it stands for. ``again_*`` asks a kept sketch for its value, after a
look at the source's plan and files, as every question does; ``again_sql_*`` is the same through SQL, with a DataFrame as the
answer. ``append*`` adds the events once more to a table without and with sketches to maintain. ``sql_*`` are statements
with approximate functions. All sketches here are the native or xxHash64 ones, at (0.05, 0.90).
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from boundwise.plans import catalogue
from boundwise.plans.calls import rewritten
from boundwise.plans.statements import Hint
from boundwise.session import Session

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
ASK = {
    "count_distinct": ("approx_count_distinct(l_partkey, 0.05, 0.9)", "count(DISTINCT l_partkey)"),
    "median": ("approx_median(l_extendedprice, 0.05, 0.9)", "percentile(l_extendedprice, 0.5)"),
    "freq": ("approx_freq(l_suppkey, 1, 0.05, 0.9)", "count_if(l_suppkey = 1)"),
    "topk": ("approx_top_k(l_suppkey, 10, 0.05, 0.9)", None),
}


def timed(f, times: int = 3) -> float:
    took = []
    for _ in range(times):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return round(median(took), 8)


def built(spark: SparkSession, ask: str) -> None:
    with Session(spark, hash_seed=7) as session:
        session.sql(ask).collect()


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/boundwise-bench").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.views(spark, SF_DIR)
    out: dict[str, float] = {}
    spark.sql("SELECT count(DISTINCT l_orderkey), percentile(l_tax, 0.5) FROM lineitem").collect()  # warm up
    for name, (approx, exact) in ASK.items():
        ask = f"SELECT {approx} FROM lineitem"
        out[f"build_{name}"] = timed(lambda ask=ask: built(spark, ask))
        with Session(spark, hash_seed=7) as session:
            session.value(ask)
            out[f"again_{name}"] = timed(lambda s=session, ask=ask: s.value(ask), 21)
            out[f"again_sql_{name}"] = timed(lambda s=session, ask=ask: s.sql(ask).collect(), 5)
        if exact:
            out[f"exact_{name}"] = timed(lambda exact=exact: spark.sql(f"SELECT {exact} FROM lineitem").collect())
        if name != "topk":
            out[f"sql_{name}_by_flag"] = timed(lambda approx=approx: spark.sql(rewritten(f"SELECT l_returnflag, {approx} AS x FROM lineitem GROUP BY l_returnflag")).collect())
    out["exact_topk"] = timed(lambda: spark.sql("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10").collect())
    for name in ("approx_count_distinct_events", "approx_count_distinct_join", "cms_cells", "window_sketch_daily"):
        out[name] = timed(lambda name=name: catalogue.queries()[name](spark, SF_DIR).collect())
    events = catalogue.table(spark, SF_DIR, "events").select("user_id", "value")
    for name, sketches in (("append", False), ("append_with_sketches", True)):
        spark.sql("DROP TABLE IF EXISTS bench_events")
        spark.sql("CREATE TABLE bench_events (user_id bigint, value double) USING parquet")
        session = Session(spark, hash_seed=7)
        session.append(events, "bench_events", Hint(("user_id", "value"), 0.05, 0.9) if sketches else None)
        if not sketches:
            out[name] = timed(lambda: events.write.insertInto("bench_events"))
        else:
            out[name] = timed(lambda s=session: s.append(events, "bench_events"))
    spark.sql("DROP TABLE IF EXISTS bench_events")
    total = round(sum(v for k, v in out.items() if not k.startswith("exact_")), 3)
    print(json.dumps({"metric": "seconds of all approximate queries", "value": total, "unit": "sec", "queries": out, "sf": SF_DIR.rpartition("/sf")[2], "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
