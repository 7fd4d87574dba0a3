"""Run queries next to their SQL: ``python -m driver_checks.compare DIR [PREFIX ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .oracles import ORACLES
from .queries import QUERIES

# The tables the driver registers.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(repr([row[i] for i in order]) for row in rows)


def main(sf_dir: str, *prefixes: str) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = duckdb.connect()
    for table in TABLES:
        tables.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = 0
    for name, query in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.perf_counter()
        frame = query(spark, sf_dir)
        found = _bag(frame.columns, [tuple(row) for row in frame.collect()])
        seconds = time.perf_counter() - start
        answer = tables.sql(ORACLES[name])
        expected = _bag(answer.columns, answer.fetchall())
        same = found == expected and sorted(frame.columns) == sorted(answer.columns)
        failed += not same
        print("same" if same else "DIFFERENT", name, found.total(), f"{seconds:.1f}s", flush=True)
        if not same:
            print("  only Spark:", list((found - expected))[:3])
            print("  only SQL:  ", list((expected - found))[:3])
    print(f"{failed} different")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
