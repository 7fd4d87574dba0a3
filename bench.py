"""Headline runs, timed: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The planted runs
read N-Triples files written beforehand and cover everything from parsing to the
it took is reported too.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import factdrift as fd
from driver_checks import queries as q
from driver_checks.planted import planted_triples
from factdrift.staging import scratch_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PLANTED_ENTITIES = {"planted_16k": 2_000, "planted_80k": 10_000, "planted_320k": 40_000, "planted_4m": 500_000}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("factdrift-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 2)


def planted_files(spark: SparkSession, n_entities: int):
    entities = spark.range(n_entities).withColumnRenamed("id", "entity")
    return q.snapshot_files(planted_triples(entities))


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    rates: dict[str, int] = {}

    warm_up = planted_files(spark, 500)
    warm_up_sec = timed(lambda: fd.run_pipeline(spark, "warm-up", warm_up, 0.05, 0.5).collect())

    for name, n_entities in PLANTED_ENTITIES.items():
        sources = planted_files(spark, n_entities)
        row = fd.throughput(fd.run_pipeline(spark, name, sources, 0.05, 0.5)).first()
        times[name] = round(row["runtime_sec"], 2)
        rates[name] = round(row["triples_per_sec"])

    views = {
        "customer_rules": q.customer_facts,
        "user_rules": q.user_facts,
        "order_rules": q.order_facts,
    }
    for name, facts in views.items():
        run = q.mined(facts)
        times[name] = timed(lambda run=run: run(spark, SF_DIR).metrics.collect())

    lines = scratch_path(spark, "lines")
    fd.render_lines(q.order_facts(spark, SF_DIR)).select("value").write.text(lines)
    parsed = fd.read_ntriples(spark, lines)
    n_lines = parsed.count()
    times["parse_lines"] = timed(lambda: parsed.write.format("noop").mode("overwrite").save())
    rates["parse_lines"] = round(n_lines / max(times["parse_lines"], 0.01))

    store = scratch_path(spark, "store")
    facts = q.order_facts(spark, SF_DIR)
    times["write_store"] = timed(lambda: fd.write_store(facts, store, rebalance=True))
    times["assign_windows"] = timed(
        lambda: fd.assign_windows(fd.read_store(spark, store), 2)
        .groupBy("window_id")
        .agg(F.count("*"))
        .collect()
    )

    print(
        json.dumps(
            {
                "metric": "temporal_rule_mining_total",
                "value": round(sum(times.values()), 2),
                "unit": "sec",
                "queries": times,
                "triples_per_sec": rates,
                "warm_up_sec": warm_up_sec,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
