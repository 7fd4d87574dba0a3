import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import factdrift.staging as staging
import pytest
from factdrift.staging import bounded_join, stage, weighted_join


@pytest.fixture
def sides(spark):
    keys = ["hot"] * 600 + ["warm"] * 100 + [f"k{i}" for i in range(300)]
    big = spark.createDataFrame([(key, i) for i, key in enumerate(keys)], "key string, row long")
    weights = {key: keys.count(key) for key in set(keys)}
    small = spark.createDataFrame(
        [(key, n, f"<{key}>") for key, n in weights.items() if key != "k7"], "key string, weight long, label string"
    )
    expected = sorted((key, i, f"<{key}>") for i, key in enumerate(keys) if key != "k7")
    return big, small, expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size, broadcast_joins", [(1000, 1), (10**12, 2)])
def test_weighted_join(spark, sides, monkeypatch, size, broadcast_joins):
    big, small, expected = sides
    monkeypatch.setattr(staging, "HEAVY_KEYS", 5)
    joined = weighted_join(big, small, ["key"], size, 1000)
    assert sorted(map(tuple, joined.select("key", "row", "label").collect())) == expected
    assert joined.columns == ["key", "row", "label"]
    assert plan_of(joined).count("BroadcastHashJoin [key") >= broadcast_joins


@pytest.mark.parametrize("size", [1000, 10**12])
def test_bounded_join(sides, size):
    big, small, expected = sides
    joined = bounded_join(big, small.drop("weight"), ["key"], size, ["row"])
    assert sorted(map(tuple, joined.collect())) == expected


def test_stage_and_drop(spark):
    staged = stage(spark.range(5), "numbers")
    assert staged.path.startswith(staging.staging_root(spark))
    assert staged.frame.count() == 5
    staged.drop()
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(staged.path).count()


def session_like(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_the_session_names_the_folder():
    assert staging.staging_root(session_like("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_root(session_like("yarn"))


def test_a_local_session_gets_a_folder_of_its_own():
    session = session_like("local[2]")
    root = staging.staging_root(session)
    assert Path(root).is_dir() and staging.staging_root(session) == root


def test_staged_tables_go_when_the_application_ends(tmp_path):
    script = (
        "from pyspark.sql import SparkSession\n"
        "from factdrift.staging import stage\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        f".config('spark.checkpoint.dir', '{tmp_path}').getOrCreate()\n"
        "stage(spark.range(3), 'kept')\n"
        f"import glob; assert glob.glob('{tmp_path}/kept-*')\n"
        "spark.stop()\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(__file__).parent.parent, timeout=120)
    deadline = time.monotonic() + 30
    while list(tmp_path.glob("kept-*")) and time.monotonic() < deadline:
        time.sleep(0.5)
    assert not list(tmp_path.glob("kept-*"))
