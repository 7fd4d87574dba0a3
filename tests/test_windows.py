from datetime import datetime

import factdrift.operators.windows as windows
import factdrift.staging as staging
import pytest
from factdrift import (
    assign_windows,
    build_windows,
    ordered_snapshots,
    plan_windows,
    read_store,
    window_spans,
    write_store,
)
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F


def triples(spark, *snapshots):
    rows = [(f"e{i}", "p", "o", s, ts) for i, (s, ts) in enumerate(snapshots)]
    return spark.createDataFrame(
        rows, "subject string, predicate string, object string, snapshot string, snapshot_ts timestamp"
    )


def years(spark, n):
    return triples(spark, *((f"s{i}", datetime(2000 + i, 1, 1)) for i in range(n)))


def expected_windows(n, width, step, partial):
    """The definition, spelled out."""
    found = {}
    for k, start in enumerate(range(0, n, step)):
        members = [f"s{i}" for i in range(start, min(start + width, n))]
        if len(members) < width and not partial:
            break
        found[k] = members
    return found


@pytest.mark.parametrize("n, width, step", [(4, 2, 1), (4, 2, 2), (3, 2, 2), (5, 1, 3), (2, 3, 1), (7, 3, 2), (1, 1, 1)])
@pytest.mark.parametrize("partial", [False, True])
def test_windows_follow_the_definition(spark, n, width, step, partial):
    df = years(spark, n)
    expected = expected_windows(n, width, step, partial)
    built = build_windows(ordered_snapshots(df), width, step, partial).collect()
    assert {r.window_id: r.snapshots for r in built} == expected
    assert all(r["size"] == len(r.snapshots) for r in built)
    assert plan_windows(df, width, step, partial).n_windows == len(expected)
    tagged = assign_windows(df, width, step, partial).collect()
    assert sorted((r.window_id, r.snapshot) for r in tagged) == sorted(
        (k, s) for k, members in expected.items() for s in members
    )


def test_order_is_by_time_then_id(spark):
    df = triples(
        spark,
        ("b", datetime(2024, 1, 1)),
        ("c", datetime(2022, 1, 1)),
        ("a", datetime(2024, 1, 1)),
        ("c", datetime(2022, 1, 1)),
    )
    rows = ordered_snapshots(df).collect()
    assert [(r.position, r.snapshot, r.n_triples) for r in rows] == [(0, "c", 2), (1, "a", 1), (2, "b", 1)]


def test_one_snapshot_has_one_time(spark):
    df = triples(spark, ("a", datetime(2022, 1, 1)), ("a", datetime(2023, 1, 1)))
    with pytest.raises(SparkRuntimeException, match="more than one timestamp: a"):
        ordered_snapshots(df).collect()


def test_arguments(spark):
    df = years(spark, 2)
    for width, step in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            assign_windows(df, width, step)
        with pytest.raises(ValueError):
            build_windows(ordered_snapshots(df), width, step)


def test_columns(spark):
    df = years(spark, 2)
    tagged = assign_windows(df, 1)
    assert tagged.columns == [*df.columns, "window_id"]
    assert dict(tagged.dtypes)["window_id"] == "int"


def test_the_calendar_prunes_the_store_when_it_runs(spark, tmp_path):
    frame = spark.range(40).select(
        F.lit("a").alias("subject"), F.lit("p").alias("predicate"), F.col("id").cast("string").alias("object"),
        F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("language"),
        F.timestamp_add("DAY", F.col("id").cast("int") % 8, F.lit("2020-01-01").cast("timestamp")).alias("snapshot_ts"),
        F.concat(F.lit("s"), F.col("id") % 8).alias("snapshot"),
    )
    write_store(frame, str(tmp_path / "store"))
    store = read_store(spark, str(tmp_path / "store"))
    found = assign_windows(store, 1, 4)
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    assert {(r.snapshot, r.window_id) for r in found.collect()} == {("s0", 0), ("s4", 1)}
