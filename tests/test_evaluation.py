import csv
import json

import pytest
from factdrift import (
    named_rule_check,
    read_rule_export,
    rule_measures,
    rules_file_summary,
    run_pipeline,
    temporal_rules,
    temporal_summary,
    throughput,
    write_rule_measures,
    write_summaries,
)
from driver_checks.planted import PERSISTENT_RULE, TRANSIENT_RULE, planted_triples
from factdrift.plans import SUMMARY_SCHEMA
from samples import write_snapshots


def summary_of(spark, folder, **files):
    for name, text in files.items():
        (folder / name.replace("_", ".")).write_text(text, encoding="utf-8")
    return tuple(rules_file_summary(spark, str(folder)).first())


def test_rules_file_with_header(spark, tmp_path):
    text = "antecedent,consequent,support,confidence\nA,B,0.5,0.8\nC,D,0.3,0.6\n"
    assert summary_of(spark, tmp_path, rules_csv=text) == pytest.approx((2, 0.7, 0.4))


def test_rules_file_without_header(spark, tmp_path):
    assert summary_of(spark, tmp_path, rules_txt="A => B\nC => D\n\n , \nE => F\n") == (3, None, None)


def test_rules_files_of_several_layouts(spark, tmp_path):
    found = summary_of(
        spark,
        tmp_path,
        a_csv='rule, Confidence\n"x,y",0.5\n"say ""z""",oops\n , \n',
        b_csv="SUPPORT,confidence\n0.2,1e0\n0.4\n",
        c_tsv="just\nrows\n",
        d_json="support\nignored\n",
    )
    assert found == pytest.approx((6, 0.75, 0.3))


def test_line_breaks_in_quotes(spark, tmp_path):
    found = summary_of(
        spark,
        tmp_path,
        a_csv='rule,confidence,support\n"x\ny",0.5,0.2\n"5"" z",0.7,0.4\n\n',
        b_csv='5" pipe,"one\n6" more,"two\n',
        c_txt='"a\nb" => c\n" \n ",\nd => e\n',
        d_csv=',support,rule\n0,0.6,z\n1,,"last\n"\n',
    )
    assert found == pytest.approx((2 + 1 + 2 + 2, 0.6, 0.4))


def test_a_header_over_several_lines_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="Line break in the header"):
        summary_of(spark, tmp_path, a_csv='confidence,"the\nrule"\n0.5,x\n')


def test_no_rules_files(spark, tmp_path):
    assert summary_of(spark, tmp_path, notes_md="x") == (0, None, None)


EXPORT = [
    {"head": {"a": 1}, "measures": [{"name": "CwaConfidence", "value": 0.5}, {"name": "HeadCoverage", "value": 0.1}]},
    {"measures": [{"name": "Confidence", "value": 0}, {"name": "PcaConfidence", "value": 0.3}]},
    {"measures": {"CWACONFIDENCE": 0.0, "confidence": 0.9, "Support": 12}},
    {"Confidence": 0.7, "headcoverage": 0.0, "support": 3, "body": ["x"]},
    {"measures": []},
]
MEASURES = [(0.1, 0.5), (None, 0.3), (12.0, 0.0), (0.0, 0.7), (None, None)]


@pytest.mark.parametrize("layout", ["lines", "array on one line", "array", "one object"])
def test_rule_export(spark, tmp_path, layout):
    rules, expected = (EXPORT[:1], MEASURES[:1]) if layout == "one object" else (EXPORT, MEASURES)
    text = {
        "lines": "\n".join(json.dumps(rule) for rule in rules) + "\n\n",
        "array on one line": json.dumps(rules),
        "array": json.dumps(rules, indent=2),
        "one object": json.dumps(rules[0], indent=2),
    }[layout]
    path = tmp_path / "export.json"
    path.write_text(text)
    found = rule_measures(read_rule_export(spark, str(path))).collect()
    assert [tuple(r) for r in found] == expected


def test_rule_exports_of_several_layouts(spark, tmp_path):
    folder = tmp_path / "exports of rules"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"support": i} for i in range(200)], indent=2))
    (folder / "b.json").write_text("\n".join(json.dumps({"support": i}) for i in range(200, 250)))
    (folder / "c 1.json").write_text(json.dumps([{"support": 250}]) + "\n")
    found = rule_measures(read_rule_export(spark, str(folder))).collect()
    assert sorted(row.support for row in found) == list(range(251))


@pytest.mark.parametrize("text", ['{"support": 1}\n{"support": \n', '[\n{"support": 1}\n]\n{"support": 2}\n'])
def test_broken_rule_export(spark, tmp_path, text):
    (tmp_path / "export.json").write_text(text)
    with pytest.raises(Exception, match="Not JSON"):
        read_rule_export(spark, str(tmp_path)).collect()


def read_csv(folder):
    rows = []
    for part in sorted(folder.glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_rule_measures_sink(spark, tmp_path):
    df = spark.createDataFrame([(0.5, None), (None, 0.25)], "support double, confidence double")
    write_rule_measures(df, str(tmp_path / "out"))
    assert sorted(map(tuple, map(dict.values, read_csv(tmp_path / "out")))) == [("", "0.25"), ("0.5", "")]


def test_sample_run(spark, tmp_path):
    summary = run_pipeline(spark, "sample", write_snapshots(tmp_path), 0.5, 0.5)
    (row,) = summary.collect()
    assert (row.status, row.supports_temporal, row.n_input_triples, row.n_rules) == ("ok", True, 15, 9)
    assert row.extra["n_windows"] == 2
    assert row.mean_confidence == pytest.approx((6 * 1.0 + 3 * 0.5) / 9)
    assert row.mean_support == pytest.approx((2 * (5 / 6) + 7 * 0.25) / 9)
    assert row.extra["mean_persistence"] == pytest.approx((2 * 1.0 + 4 * 0.5) / 9)
    assert row.extra["mean_abs_drift"] == 0.0
    rated = throughput(summary).first()
    assert rated.triples_per_sec == pytest.approx(15 / row.runtime_sec)


def test_a_run_leaves_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("factdrift.staging.staging_root", lambda spark: str(tmp_path / "staged"))
    run_pipeline(spark, "sample", write_snapshots(tmp_path), 0.5, 0.5).collect()
    assert list((tmp_path / "staged").iterdir()) == []


def test_golden_metrics(spark, tmp_path):
    from factdrift import store_snapshots

    found = temporal_rules(store_snapshots(spark, write_snapshots(tmp_path)), 0.5, 0.5)
    rows = found.metrics.collect()
    assert len(rows) == 9
    assert [round(r.persistence_score, 3) for r in rows] == [1.0] * 2 + [0.5] * 4 + [0.0] * 3
    assert [round(r.temporal_support, 4) for r in rows] == [0.8333] * 2 + [0.25] * 7


def test_run_without_rules(spark, tmp_path):
    sources = {"2024": write_snapshots(tmp_path)["2024"]}
    (row,) = run_pipeline(spark, "sample", sources, 1.0, 1.0).collect()
    assert (row.status, row.n_rules, row.mean_confidence) == ("ok", 0, None)
    assert row.extra == {"n_windows": 1.0, "mean_persistence": 0.0, "mean_abs_drift": 0.0}


@pytest.fixture
def summaries(spark):
    rows = [
        ("one", "d", "ok", True, 10, 2.0, 3, 0.5, 0.25, "", {"n_windows": 2.0, "mean_persistence": 0.5}),
        ("two", "d", "skipped", True, None, None, None, None, None, "off", {}),
        ("three", "d", "ok", False, 10, 1.0, 7, 0.5, None, "", {"z": 1.0}),
    ]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def test_temporal_summary(summaries):
    assert [tuple(r) for r in temporal_summary(summaries).collect()] == [("one", "d", 2.0, 0.5, None)]


def test_summary_sink(summaries, tmp_path):
    write_summaries(summaries, str(tmp_path / "out"))
    rows = {row["system"]: row for row in read_csv(tmp_path / "out")}
    assert list(rows["one"])[-3:] == ["mean_persistence", "n_windows", "z"]
    assert (rows["one"]["n_windows"], rows["one"]["z"], rows["two"]["note"]) == ("2.0", "", "off")


def test_planted_triples(spark):
    entities = spark.range(10).withColumnRenamed("id", "entity")
    triples = planted_triples(entities, n_snapshots=3)
    assert triples.count() == 2 * 10 * 3
    again = planted_triples(entities.repartition(3), n_snapshots=3)
    assert sorted(map(tuple, triples.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    other = planted_triples(entities, n_snapshots=3, seed=1)
    assert triples.exceptAll(other).count() > 0


def test_planted_rules_are_found(spark):
    entities = spark.range(500).withColumnRenamed("id", "entity")
    found = temporal_rules(planted_triples(entities, seed=1), 0.05, 0.5, tau=0.5)
    checked = {r.rule: r for r in named_rule_check(found.metrics, {"persistent": PERSISTENT_RULE, "transient": TRANSIENT_RULE}).collect()}
    assert checked["persistent"].persistence_score == pytest.approx(1.0)
    transient = checked.get("transient")
    assert transient is None or transient.persistence_score < 1.0


def test_a_quoted_file_is_split_over_tasks(spark, tmp_path):
    rows = [(f'rule {k},\n"{"x" * (k % 40)}"\n', k / 1000) for k in range(400)]
    text = "rule,confidence\n" + "".join('"{}",{}\n'.format(rule.replace('"', '""'), c) for rule, c in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "rules.csv").write_text(text, encoding="utf-8")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        found = rules_file_summary(spark, str(tmp_path)).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (found.n_rules, found.mean_confidence) == (400, pytest.approx(sum(c for _, c in rows) / 400))
