from datetime import datetime

import pytest
from factdrift import ingest_snapshot, ingest_snapshots, read_store, replace_snapshots, write_store
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F
from samples import write_snapshots


def test_tags(spark, tmp_path):
    path, ts = write_snapshots(tmp_path)["2023"]
    rows = ingest_snapshot(spark, path, "first", ts).collect()
    assert len(rows) == 7
    assert {(r.snapshot, r.snapshot_ts) for r in rows} == {("first", datetime(2023, 1, 1))}


def test_union_keeps_duplicates(spark, tmp_path):
    sources = write_snapshots(tmp_path)
    assert ingest_snapshots(spark, sources).count() == 15
    again = {**sources, "copy": sources["2023"]}
    assert ingest_snapshots(spark, again).count() == 22


def test_nothing_to_ingest(spark):
    with pytest.raises(ValueError):
        ingest_snapshots(spark, {})


@pytest.mark.parametrize("rebalance", [False, True])
def test_store_round_trip(spark, tmp_path, rebalance):
    triples = ingest_snapshots(spark, write_snapshots(tmp_path))
    store = str(tmp_path / "store")
    write_store(triples, store, rebalance=rebalance)
    back = read_store(spark, store)
    assert dict(back.dtypes)["snapshot"] == "string"
    columns = sorted(triples.columns)
    assert sorted(back.select(columns).collect(), key=str) == sorted(triples.select(columns).collect(), key=str)
    assert back.where("snapshot = '2024'").count() == 8


def test_snapshot_ids_stay_text(spark, tmp_path):
    path, ts = write_snapshots(tmp_path)["2023"]
    store = str(tmp_path / "store")
    write_store(ingest_snapshots(spark, {"01": (path, ts), "2024-01-01": (path, ts)}), store)
    found = read_store(spark, store).select("snapshot").distinct().collect()
    assert {r.snapshot for r in found} == {"01", "2024-01-01"}


def test_store_reads_only_the_snapshots_asked_for(spark, tmp_path):
    store = str(tmp_path / "store")
    write_store(ingest_snapshots(spark, write_snapshots(tmp_path)), store)
    pruned = read_store(spark, store, snapshots=["2024"])
    assert pruned.count() == 8
    scan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "snapshot#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    files = pruned.select(F.input_file_name()).distinct().collect()
    assert all("snapshot=2024" in f[0] for f in files)


def test_many_snapshots_are_one_scan(spark, tmp_path):
    sources = {}
    for k in range(40):
        path = tmp_path / f"day {k:02}" if k % 2 else tmp_path / f"k={k}.nt"
        if k % 2:
            path.mkdir()
        (path / "x.nt" if k % 2 else path).write_text(f"<http://a/{k}> <http://p> <http://o> .\n# {k}\nbroken\n")
        sources[f"s{k}"] = (str(path), datetime(2020, 1, 1 + k % 28))
    counts = Observation()
    found = ingest_snapshots(spark, sources, observation=counts)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert {(r.subject, r.snapshot, r.snapshot_ts) for r in found.collect()} == {
        (f"http://a/{k}", f"s{k}", datetime(2020, 1, 1 + k % 28)) for k in range(40)
    }
    assert counts.get == {"n_lines": 120, "n_triples": 40, "n_skipped": 40, "n_malformed": 40}


def test_globs_and_paths_of_different_depths(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    for name in ("x1.nt", "x2.nt", "y.nt"):
        (tmp_path / name).write_text(f"<http://{name}> <http://p> <http://o> .\n")
    (deep / "z.nt").write_text("<http://z> <http://p> <http://o> .\n")
    ts = datetime(2020, 1, 1)
    sources = {"x": (f"{tmp_path}/x*.nt", ts), "y": (f"{tmp_path}/y.nt", ts), "z": (f"file://{deep}", ts)}
    found = {(r.subject, r.snapshot) for r in ingest_snapshots(spark, sources).collect()}
    assert found == {("http://x1.nt", "x"), ("http://x2.nt", "x"), ("http://y.nt", "y"), ("http://z", "z")}


def test_a_missing_path_is_an_error(spark, tmp_path):
    sources = write_snapshots(tmp_path)
    with pytest.raises(AnalysisException):
        ingest_snapshots(spark, {**sources, "no": (str(tmp_path / "none.nt"), datetime(2020, 1, 1))}).collect()


def test_replacing_a_snapshot_again_changes_nothing(spark, tmp_path):
    triples = ingest_snapshots(spark, write_snapshots(tmp_path))
    store = str(tmp_path / "store")
    write_store(triples, store)
    before = {(r.subject, r.predicate, r.object) for r in read_store(spark, store, ["2024"]).collect()}
    fewer = triples.where("snapshot = '2023' AND object_kind = 'literal'")
    for _ in range(2):
        replace_snapshots(fewer, store)
        assert read_store(spark, store, ["2023"]).count() == 2
        assert {(r.subject, r.predicate, r.object) for r in read_store(spark, store, ["2024"]).collect()} == before
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_store(fewer, store)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read_store(spark, store).count() == 2
