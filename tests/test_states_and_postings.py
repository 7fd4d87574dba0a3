import random

import factdrift.staging as staging
import pytest
from factdrift import applicable_rules, compute_metrics, merge_states, metrics_of_states, rule_states
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

RULES = "window_id int, rule_key string, antecedent array<string>, consequent array<string>, support double, confidence double"


def random_rules(spark, n_windows=9):
    rng = random.Random(4)
    rows = [
        (w, f"a{r} => b", [f"a{r}"], ["b"], rng.random(), rng.random())
        for r in range(12)
        for w in range(n_windows)
        if rng.random() < r / 8
    ]
    return spark.createDataFrame(rows, RULES)


@pytest.mark.parametrize("cuts", [(3, 6), (1, 8), (0, 9)])
def test_merged_states_have_the_metrics_of_all_windows(spark, cuts):
    rules = random_rules(spark)
    a, b, c = (
        rule_states(rules.where(F.col("window_id").between(first, last - 1)))
        for first, last in ((0, cuts[0]), (cuts[0], cuts[1]), (cuts[1], 9))
    )
    expected = compute_metrics(rules, n_windows=9)
    columns = [name for name in expected.columns if not name.endswith("_series")]
    expected = sorted(map(tuple, expected.select(columns).collect()))
    for merged in (merge_states(merge_states(a, b), c), merge_states(a, merge_states(b, c))):
        found = sorted(map(tuple, metrics_of_states(merged, 9).select(columns).collect()))
        assert len(found) == len(expected) > 5
        for one, other in zip(found, expected):
            assert one[:3] == other[:3] and one[3:] == pytest.approx(other[3:])


def test_overlapping_states_do_not_merge(spark):
    rules = random_rules(spark)
    with pytest.raises(SparkRuntimeException, match="overlapping"):
        merge_states(rule_states(rules), rule_states(rules)).collect()
    with pytest.raises(ValueError):
        metrics_of_states(rule_states(rules), 0)


@pytest.mark.parametrize("limit", [-1, staging.BROADCAST_BYTES])
def test_rules_whose_antecedent_a_set_holds(spark, monkeypatch, limit):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    rng = random.Random(2)
    items = "pqrstu"
    rules = {f"r{k}": sorted(rng.sample(items, rng.randint(1, 4))) for k in range(30)}
    sets = {k: rng.sample(items, rng.randint(0, 6)) for k in range(50)}
    rows = [(k, item) for k, held in sets.items() for item in held] * 2 + [(99, None)]
    frame = spark.createDataFrame(rows, "k int, item string")
    rule_frame = spark.createDataFrame([(name, a, ["c"]) for name, a in rules.items()] * 2, "rule_key string, antecedent array<string>, consequent array<string>")
    found = {(r.k, r.rule_key) for r in applicable_rules(frame, ["k"], rule_frame).collect()}
    assert found == {(k, name) for k, held in sets.items() for name, a in rules.items() if set(a) <= set(held)}


def test_hits_are_not_shuffled(spark):
    """Sets meet the rules' lists where they are: nothing is dealt anew once the lists are unfolded."""
    sets = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "k int, item string")
    rules = spark.createDataFrame([("r", ["p", "q"], ["c"])], "rule_key string, antecedent array<string>, consequent array<string>")
    found = applicable_rules(sets, ["k"], rules)
    assert [tuple(r) for r in found.collect()] == [(1, "r", ["c"])]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate inline")]
