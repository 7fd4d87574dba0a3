"""A task of the store's writer has a bounded part of a snapshot; no line of rule files is sorted."""

import factdrift.sources.store as store
from factdrift import read_store, replace_snapshots, write_store
from factdrift.sources.rule_files import _layouts
from pyspark.sql import functions as F

COLUMNS = ["subject", "predicate", "object", "object_kind", "datatype", "language", "snapshot_ts", "snapshot"]


def facts(spark, sizes):
    rows = [(f"s{k}", "p", "o", "iri", None, None, None, name) for name, n in sizes.items() for k in range(n)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} {'timestamp' if c == 'snapshot_ts' else 'string'}" for c in COLUMNS))
    return frame.repartition(3, "subject")


def test_large_snapshots_are_split_and_small_ones_are_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_TASK_BYTES", 200 * 100)
    sizes = {"2001": 1000, "2002": 7, None: 5, "2003": 60}
    path = str(tmp_path / "store")
    for _ in range(2):
        write_store(facts(spark, sizes), path, rebalance=True)
        replace_snapshots(facts(spark, {"2002": 9}), path, rebalance=True)
    found = read_store(spark, path).withColumn("file", F.input_file_name())
    assert {(r.snapshot, r.subject) for r in found.collect()} == {
        (name, f"s{k}") for name, n in {**sizes, "2002": 9}.items() for k in range(n)
    }
    per_file = found.groupBy("snapshot", "file").count().collect()
    assert sum(r["count"] for r in per_file) == 1074
    assert max(r["count"] for r in per_file) < 200
    assert all(sum(r.snapshot == name for r in per_file) == 1 for name in ("2002", "2003", None))


def test_lines_of_rule_files_are_not_sorted_for_their_layouts(spark):
    rows = [("f", 'a,"b', 0, 2), ("f", "support,x", 0, 1), ("g", "1,2", 0, 1), ("g", "3,4", 9, 2)]
    lines = spark.createDataFrame(rows, "file string, value string, start long, row long")
    found = _layouts(lines, ",")
    assert {(r.file, r.by_line, r.support) for r in found.collect()} == {("f", False, 1), ("g", True, 0)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
