"""What a run from files does for each line and fact, and that the short ways give the same."""

from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from factdrift import ingest_snapshots, parse_lines
from factdrift.operators import mining_input, snapshots
from factdrift.operators.windows import plan_windows
from factdrift.sources import ntriples

LINES = [
    "<a> <b> <c> .",
    "<a b> <c> <d\te> .",
    "<a> <b> <<c> .",
    "<> <b> <c> .",
    "<a> <> <c> .",
    "<a> <b> <> .",
    "<a> <b> <c> .>",
    "<a> <b> <c>  .",
    "<a> <b> <c> . ",
    "<a> <b> <c> . # <d>",
    "<a> <b>  <c> .",
    "<a>  <b> <c> .",
    "<a><b><c>.",
    " <a> <b> <c> .",
    "<a\x01> <b> <c> .",
    "<a> <b\x01x> <c> .",
    "_:a <b> <c> .",
    "<a> <b> _:c .",
    '<a> <b> "c" .',
    '<a> <b> "> <c> ." .',
    "<a> _:b <c> .",
    "<a> <b> <c>",
    "<ü> <日本> <😀> .",
    "# <a> <b> <c> .",
    "> <b> <c> .",
    "",
    None,
]


@pytest.mark.parametrize("observed", [False, True])
def test_cut_lines_are_matched_lines(spark, monkeypatch, observed):
    lines = spark.createDataFrame(list(enumerate(LINES)), "n int, value string")

    def parsed():
        counts = Observation() if observed else None
        rows = sorted(parse_lines(lines, observation=counts).collect(), key=lambda r: r["n"])
        return rows, counts and counts.get

    short = parsed()
    monkeypatch.setattr(ntriples, "_is_plain", lambda line, cut: F.lit(False))
    assert short == parsed()
    assert [r["n"] for r in short[0]][:3] == [0, 1, 2]


def test_plain_lines_are_not_matched(spark, monkeypatch):
    """They are read although the pattern takes every line for malformed."""
    monkeypatch.setattr(ntriples, "_LINE", r"(?s)\A.*\z")
    monkeypatch.setattr(ntriples, "_FIELDS", ntriples._SEP * 6)
    lines = spark.createDataFrame([("<a> <b> <c> .",), ('<a> <b> "c" .',)], "value string")
    assert [r["object"] for r in parse_lines(lines).collect()] == ["c"]


def test_a_line_does_not_look_at_its_path(spark, tmp_path, monkeypatch):
    sources = {}
    for k, name in enumerate(["a b", "p%20q", "ü=1", "x#y"]):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"f {k}%.nt").write_text(f"<s{k}> <p> <o> .\n")
        sources[name] = (str(tmp_path / name), datetime(2020 + k, 1, 1))
    triples = ingest_snapshots(spark, sources)
    assert "file_path" not in triples._jdf.queryExecution().optimizedPlan().toString()
    found = {tuple(r) for r in triples.select("subject", "snapshot", "snapshot_ts").collect()}
    assert found == {(f"s{k}", name, sources[name][1]) for k, name in enumerate(sources)}
    # Too many files for a map of them.
    monkeypatch.setattr(snapshots, "BROADCAST_BYTES", 0)
    by_path = ingest_snapshots(spark, sources)
    assert {tuple(r) for r in by_path.select("subject", "snapshot", "snapshot_ts").collect()} == found


def masked(spark, n_snapshots):
    """Subjects with facts that come and go; 1 in 7 is the only one with its item."""
    rows = spark.range(600).select(
        F.concat(F.lit("s"), F.col("id") % 41).alias("subject"),
        F.lit("p").alias("predicate"),
        F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("id") % 5).cast("string").alias("object"),
        F.lit("iri").alias("object_kind"),
        F.pmod(F.xxhash64("id"), F.lit(n_snapshots)).alias("at"),
    )
    triples = rows.withColumns(
        {
            "snapshot": F.col("at").cast("string"),
            "snapshot_ts": F.timestamp_seconds(F.col("at") * 86400),
        }
    ).drop("at")
    return mining_input.items_of_triples(triples, plan_windows(triples, 2))


@pytest.mark.parametrize("n_snapshots", [6, 150])
def test_equal_windows_are_counted_once(spark, n_snapshots):
    items = masked(spark, n_snapshots)
    plan = items.counted()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate")[1]
    apart = items.rows.groupBy("window_id", "item").count()
    assert {tuple(r) for r in items.counted().collect()} == {tuple(r) for r in apart.collect()}
    subjects = items.staged.frame.select(F.explode(items.window_ids()).alias("window_id"), "subject").distinct()
    expected = {tuple(r) for r in subjects.groupBy("window_id").count().collect()}
    assert {tuple(r) for r in items.sizes.select("window_id", "n_transactions").collect()} == expected


@pytest.mark.parametrize("n_snapshots", [6, 150])
def test_few_items_are_merged_without_lists(spark, monkeypatch, n_snapshots):
    items = masked(spark, n_snapshots)
    counts = items.counted().where("item in ('p=1', 'p=2', 'p=3', 'p=4')")
    frequent = counts.where("window_id % 4 < 3").withColumns({"n_tx": F.lit(41).cast("long"), "cut": F.lit(1)})
    dictionary = mining_input.stage(items.dictionary(frequent), "dictionary").frame
    size = mining_input.DictionarySize(dictionary.count(), 1000, 10000)

    def baskets():
        found = items.baskets(dictionary, size)
        rows = found.select("window_id", F.sort_array("ids").alias("ids")).collect()
        return found._jdf.queryExecution().optimizedPlan().toString(), sorted((r["window_id"], r["ids"]) for r in rows)

    plan, few = baskets()
    assert few and "collect_list" not in plan
    monkeypatch.setattr(mining_input, "PACKED_WORDS", 0)
    plan, many = baskets()
    assert "collect_list" in plan and few == many
