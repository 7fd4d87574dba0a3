from itertools import pairwise
from random import Random

import pytest
from factdrift import (
    by_persistence,
    compute_metrics,
    mine,
    persistence_label,
    rule_trajectories,
    rules_with_items,
    top_rules,
)
from factdrift.functions import short_label

RULES = (
    "rule_key string, antecedent array<string>, consequent array<string>, "
    "window_id int, support double, confidence double"
)


def rules(spark, *rows):
    """Rows of (key, window, support, confidence)."""
    return spark.createDataFrame([(k, ["A"], ["B"], w, s, c) for k, w, s, c in rows], RULES)


def plain_metrics(seen, n, tau):
    """Metrics of one rule, {window: (support, confidence)}, by definition."""
    windows = sorted(seen)
    c = [seen[w][1] for w in windows]
    steps = len(c) - 1
    return {
        "occurrences": len(c),
        "first_window": windows[0],
        "last_window": windows[-1],
        "temporal_support": sum(seen[w][0] for w in windows) / n,
        "mean_confidence": sum(c) / len(c),
        "first_confidence": c[0],
        "last_confidence": c[-1],
        "confidence_drift": c[-1] - c[0],
        "confidence_drift_rate": (c[-1] - c[0]) / steps if steps else 0.0,
        "confidence_volatility": sum(abs(y - x) for x, y in pairwise(c)) / steps if steps else 0.0,
        "persistence_score": sum(x >= tau for x in c) / n,
    }


@pytest.mark.parametrize("tau", [0.0, 0.45, 1.0])
@pytest.mark.parametrize("total", [23, None])
def test_metrics_of_random_trajectories(spark, tau, total):
    """Gaps, single observations and confidences on the threshold are among them."""
    random = Random(11)
    rules_seen = {
        f"rule {k:02}": {w: (random.random(), random.choice([0.45, random.random()])) for w in random.sample(range(23), random.choice([1, 2, 5, 19]))}
        for k in range(40)
    }
    rows = [(key, w, *values) for key, seen in rules_seen.items() for w, values in seen.items()]
    random.shuffle(rows)
    found = {r.rule_key: r.asDict() for r in compute_metrics(rules(spark, *rows), n_windows=total, tau=tau).collect()}
    n = total or len({w for _, w, *_ in rows})
    assert found.keys() == rules_seen.keys()
    for key, seen in rules_seen.items():
        wanted = plain_metrics(seen, n, tau)
        assert {name: found[key][name] for name in wanted} == pytest.approx(wanted)
        assert found[key]["window_series"] == sorted(seen)
        assert found[key]["support_series"] == [seen[w][0] for w in sorted(seen)]
        assert found[key]["confidence_series"] == [seen[w][1] for w in sorted(seen)]


def test_order(spark):
    df = rules(spark, ("R2", 0, 0.6, 0.7), ("R3", 0, 0.6, 0.9), ("R1", 0, 0.6, 0.9), ("R1", 1, 0.6, 0.95))
    metrics = compute_metrics(df, n_windows=2, tau=0.6)
    assert [r.rule_key for r in metrics.collect()] == ["R1", "R2", "R3"]
    assert [r.rule_key for r in by_persistence(metrics).collect()] == ["R1", "R3", "R2"]
    kinds = {r.rule_key: r.kind for r in persistence_label(metrics).collect()}
    assert kinds == {"R1": "PERSISTENT", "R2": "TRANSIENT", "R3": "TRANSIENT"}
    assert [(r.rule_key, r.window_id) for r in top_rules(df, 2).collect()] == [("R1", 1), ("R1", 0)]


def test_antecedents_are_sets(spark):
    df = spark.createDataFrame(
        [("a,b => c", ["a", "b"], ["c"], 0, 0.5, 0.9), ("a,b => c", ["b", "a"], ["c"], 1, 0.5, 0.9)], RULES
    )
    (row,) = rule_trajectories(df).collect()
    assert [o.window_id for o in row.obs] == [0, 1]


@pytest.mark.parametrize("n", [0, -1])
def test_window_count_is_positive(spark, n):
    with pytest.raises(ValueError):
        compute_metrics(rules(spark, ("R", 0, 0.5, 0.5)), n_windows=n)


def test_no_rules(spark):
    empty = rules(spark, ("R", 0, 0.5, 0.5)).limit(0)
    with pytest.raises(ValueError):
        compute_metrics(empty)
    assert compute_metrics(empty, n_windows=3).count() == 0


def test_rule_lookup_wants_single_items(spark):
    df = spark.createDataFrame(
        [("a => b", ["a"], ["b"], 0, 0.5, 0.9), ("a,c => b", ["a", "c"], ["b"], 0, 0.5, 0.9)], RULES
    )
    assert [r.rule_key for r in rules_with_items(df, "a", "b").collect()] == ["a => b"]
    assert rules_with_items(df, "b", "a").count() == 0


def test_short_label(spark):
    df = spark.createDataFrame([(["http://a/b=http://c/d", "plain"],)], "items array<string>")
    assert df.select(short_label("items")).first()[0] == ["d", "plain"]
