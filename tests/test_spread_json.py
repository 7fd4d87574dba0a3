"""Elements of spread arrays, cut at every place that Spark may split a file."""

import json
import random

import pytest
from factdrift import read_rule_export, rule_measures
from factdrift.sources.spread_json import array_elements
from test_quoted import split_lines

VALUES = [{}, {"a": 1}, {"a": [1, [2, {"b": "],[{"}]]}, {"t": 'say \\"x\\", [1'}, {"n": {"m": {"k": [[], {}]}}}, {"": None}, {"q": '\\\\"'}]


def spread(values, rng, indent):
    text = json.dumps(values, indent=indent, ensure_ascii=False)
    # Line breaks at some more places where JSON lets them be.
    out, inside, escaped = [], False, False
    for c in text:
        out.append(c)
        if inside:
            escaped, inside = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "[]{},:" and rng.random() < 0.2:
            out.append("\n")
    return "".join(out)


@pytest.mark.parametrize("size", [1, 9, 60, 100_000])
def test_elements_however_a_file_is_split(spark, size):
    rng = random.Random(size)
    arrays = {f"f{k}": [rng.choice(VALUES) for _ in range(n)] for k, n in enumerate((0, 1, 2, 40))}
    files = {name: spread(values, rng, rng.choice([None, 2])) for name, values in arrays.items()}
    files["f0"] = "[\n\n]\n"
    found = array_elements(split_lines(spark, files, size)).collect()
    got = {name: sorted(json.dumps(json.loads(r.value)) for r in found if r.file == name) for name in arrays}
    assert got == {name: sorted(map(json.dumps, values)) for name, values in arrays.items()}


@pytest.mark.parametrize("text", ["[\n{}\n", "[\n{}\n]\n]\n", "[\n{},\n]\n", "[\n{}\n]\nx\n", "[\n{}\n}\n", "[\n1\n]\n[\n2\n]\n", "[\n,{}\n]\n", "x[\n]\n"])
@pytest.mark.parametrize("size", [1, 100])
def test_other_texts_are_refused(spark, text, size):
    with pytest.raises(Exception, match="Not JSON"):
        array_elements(split_lines(spark, {"f": text}, size)).collect()


def test_a_spread_export_is_split_over_tasks(spark, tmp_path):
    rules = [{"head": f"h{k}", "measures": [{"name": "Confidence", "value": k / 300}, {"name": "Support", "value": k}]} for k in range(300)]
    (tmp_path / "rules.json").write_text(json.dumps(rules, indent=2), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps(rules[5], indent=1), encoding="utf-8")
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rules[:3])), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = rule_measures(read_rule_export(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.support for r in found) == sorted([*range(300), 5, 0, 1, 2])
    assert sum(r.confidence for r in found if r.confidence) == pytest.approx((sum(range(300)) + 5 + 3) / 300)
