import itertools
import math
import random
from datetime import datetime, timedelta

import factdrift.operators.mining as mining
import factdrift.operators.mining_input as mining_input
import factdrift.staging as staging
import pytest
from factdrift import (
    assign_windows,
    build_transactions,
    changed_entities,
    ingest_snapshots,
    mine,
    mine_rules,
    mine_triples,
    plan_windows,
    transaction_sizes,
    transactions_per_window,
)
from samples import ACME, ENGINEER, KNOWS_BOB, write_snapshots

WINDOWED = "subject string, predicate string, object string, object_kind string, window_id int"


def windowed(spark, *rows):
    return spark.createDataFrame(list(rows), WINDOWED)


TEAM = (
    ("Alice", "type", "Engineer", "iri", 0),
    ("Alice", "worksAt", "Acme", "iri", 0),
    ("Bob", "type", "Engineer", "iri", 0),
    ("Bob", "worksAt", "Acme", "iri", 0),
)


def test_transactions_are_sets(spark):
    df = windowed(spark, *TEAM[:2], TEAM[1], ("Alice", "hired", "2023", "literal", 0))
    (row,) = build_transactions(df).collect()
    assert (row.subject, sorted(row["items"])) == ("Alice", ["type=Engineer", "worksAt=Acme"])
    (row,) = build_transactions(df, include_literals=True).collect()
    assert len(row["items"]) == 3


def test_changed_entities(spark):
    df = windowed(spark, *TEAM[:3])
    assert [r.subject for r in changed_entities(build_transactions(df)).collect()] == ["Alice"]
    assert {(r.subject, r.n_items) for r in transaction_sizes(df).collect()} == {("Alice", 2), ("Bob", 1)}
    assert transactions_per_window(build_transactions(df)).first().n_transactions == 2


def test_known_rule(spark):
    itemsets, rules = mine(windowed(spark, *TEAM), 0.5, 0.5)
    supports = {tuple(r["items"]): (r.freq, r.support) for r in itemsets.collect()}
    assert supports[("type=Engineer", "worksAt=Acme")] == (2, 1.0)
    found = {r.rule_key: r for r in rules.collect()}
    assert set(found) == {"type=Engineer => worksAt=Acme", "worksAt=Acme => type=Engineer"}
    assert all((r.confidence, r.lift, r.support, r.window_id) == (1.0, 1.0, 1.0, 0) for r in found.values())


def test_columns(spark):
    itemsets, rules = mine(windowed(spark, *TEAM), 0.5, 0.5)
    assert itemsets.dtypes == [
        ("window_id", "int"),
        ("items", "array<string>"),
        ("freq", "bigint"),
        ("support", "double"),
    ]
    assert rules.dtypes == [
        ("window_id", "int"),
        ("rule_key", "string"),
        ("antecedent", "array<string>"),
        ("consequent", "array<string>"),
        ("confidence", "double"),
        ("lift", "double"),
        ("support", "double"),
    ]


def test_nothing_to_mine(spark):
    with pytest.raises(ValueError):
        mine_rules(build_transactions(windowed(spark, *TEAM).limit(0)))


def test_window_wider_than_the_snapshots(spark):
    frame, _ = random_triples(spark, 2, 6, seed=1)
    plan = plan_windows(frame, 3)
    assert plan.n_windows == 0
    with pytest.raises(ValueError):
        mine_triples(frame, plan)


def test_staged_inputs_are_deleted(spark, monkeypatch):
    written = []

    def recorded(df, label):
        written.append(staging.stage(df, label))
        return written[-1]

    monkeypatch.setattr(mining_input, "stage", recorded)
    monkeypatch.setattr(mining, "stage", recorded)
    _, rules = mine(windowed(spark, *TEAM), 0.5, 0.5)
    left = [s.path for s in written if spark._jvm.java.io.File(s.path).exists()]
    assert [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in left] == ["frequent-items", "itemsets"]
    assert rules.count() == 2


def test_no_frequent_items(spark):
    df = windowed(spark, *((f"e{i}", "p", f"o{i}", "iri", 0) for i in range(4)))
    itemsets, rules = mine(df, 0.5, 0.5)
    assert itemsets.count() == 0 and rules.count() == 0


def test_single_items_only(spark):
    df = windowed(spark, *((f"e{i}", "p", "o", "iri", 0) for i in range(4)))
    itemsets, rules = mine(df, 0.5, 0.5)
    assert [(r["items"], r.freq) for r in itemsets.collect()] == [(["p=o"], 4)] and rules.count() == 0


def test_transactions_without_entities(spark):
    transactions = spark.createDataFrame(
        [(0, ["a", "b"]), (0, ["a", "b"]), (0, ["a"]), (0, [])], "window_id int, items array<string>"
    )
    itemsets, rules = mine_rules(transactions, 0.5, 0.6)
    assert {tuple(r["items"]): r.freq for r in itemsets.collect()} == {("a",): 3, ("b",): 2, ("a", "b"): 2}
    assert {r.rule_key: (r.confidence, r.lift) for r in rules.collect()} == {
        "a => b": (2 / 3, (2 / 3) / 0.5),
        "b => a": (1.0, 1 / 0.75),
    }


def test_golden_snapshots(spark, tmp_path):
    triples = ingest_snapshots(spark, write_snapshots(tmp_path)).cache()
    for itemsets, rules in (
        mine(assign_windows(triples, 1), 0.5, 0.5),
        mine_triples(triples, plan_windows(triples, 1), 0.5, 0.5),
    ):
        assert {r.window_id: r["count"] for r in itemsets.groupBy("window_id").count().collect()} == {0: 7, 1: 3}
        found = {(r.window_id, tuple(r.antecedent), r.consequent[0]): r for r in rules.collect()}
        assert len(found) == 11
        assert found[0, (ACME, ENGINEER), KNOWS_BOB].confidence == 0.5
        assert found[0, tuple(sorted((ACME, KNOWS_BOB))), ENGINEER].confidence == 1.0
        last = found[1, (ACME,), ENGINEER]
        assert (last.confidence, last.lift, last.support) == pytest.approx((1.0, 1.5, 2 / 3))
    triples.unpersist()


def brute_force(triples, windows, min_support, min_confidence):
    """Itemsets and rules from the definitions, in plain Python."""
    itemsets, rules = {}, {}
    for k, snapshots in windows.items():
        held = {}
        for subject, item, snapshot in triples:
            if snapshot in snapshots:
                held.setdefault(subject, set()).add(item)
        counts = {}
        for items in held.values():
            for size in range(1, len(items) + 1):
                for subset in itertools.combinations(sorted(items), size):
                    counts[subset] = counts.get(subset, 0) + 1
        n = len(held)
        cut = math.ceil(min_support * n)
        counts = {s: c for s, c in counts.items() if c >= cut}
        for subset, count in counts.items():
            itemsets[k, subset] = (count, count / n)
            for item in subset if len(subset) > 1 else ():
                rest = tuple(x for x in subset if x != item)
                confidence = count / counts[rest]
                if confidence >= min_confidence:
                    rules[k, rest, item] = (confidence, confidence / (counts[item,] / n), count / n)
    return itemsets, rules


def random_triples(spark, n_snapshots, n_entities, seed):
    """Snapshots of very different size, with one entity that holds far more facts."""
    rng = random.Random(seed)
    rows = set()
    for s in range(n_snapshots):
        for e in range(rng.choice([n_entities // 6, n_entities])):
            for _ in range(rng.randint(1, 4)):
                rows.add((f"e{e}", f"p{rng.randrange(3)}", f"o{rng.randrange(3)}", f"s{s:03}"))
        rows.update(("hub", "has", f"x{i}", f"s{s:03}") for i in range(8))
    full = [
        (*row[:3], "iri", row[3], datetime(2000, 1, 1) + timedelta(days=int(row[3][1:]))) for row in sorted(rows)
    ]
    frame = spark.createDataFrame(
        full,
        "subject string, predicate string, object string, object_kind string, "
        "snapshot string, snapshot_ts timestamp",
    )
    return frame, [(s, f"{p}={o}", snap) for s, p, o, snap in rows]


def values(itemsets, rules):
    return (
        {(r.window_id, tuple(r["items"])): (r.freq, pytest.approx(r.support)) for r in itemsets.collect()},
        {
            (r.window_id, tuple(r.antecedent), r.consequent[0]): pytest.approx((r.confidence, r.lift, r.support))
            for r in rules.collect()
        },
    )


@pytest.mark.parametrize("way", ["mask", "long", "windowed", "transactions", "loop", "one fit", "shuffled"])
def test_against_brute_force(spark, monkeypatch, way):
    frame, rows = random_triples(spark, 6, 30, seed=5)
    expected = brute_force(rows, {k: {f"s{k:03}", f"s{k + 1:03}"} for k in range(5)}, 0.12, 0.4)
    assert len(expected[0]) > 100 and len(expected[1]) > 100
    plan = plan_windows(frame, 2)
    if way == "windowed":
        found = mine(assign_windows(frame, 2), 0.12, 0.4)
    elif way == "transactions":
        found = mine_rules(build_transactions(assign_windows(frame, 2)), 0.12, 0.4)
    else:
        if way == "long":
            monkeypatch.setattr(mining_input, "MASK_WINDOWS", 2)
        if way == "shuffled":
            monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
            monkeypatch.setattr(staging, "HEAVY_KEYS", 5)
        ratio = {"loop": 0, "one fit": math.inf}.get(way, 2.0)
        found = mine_triples(frame, plan, 0.12, 0.4, cut_ratio=ratio)
    assert values(*found) == expected


def test_more_windows_than_one_word_holds(spark):
    frame, rows = random_triples(spark, 131, 8, seed=9)
    expected = brute_force(rows, {k: {f"s{k + i:03}" for i in range(3)} for k in range(129)}, 0.4, 0.5)
    assert max(k for k, _ in expected[0]) == 128
    found = mine_triples(frame, plan_windows(frame, 3), 0.4, 0.5)
    assert values(*found) == expected
