"""Mining by bitmaps and by differences gives what mining from scratch gives."""

import factdrift.operators.mining_input as mining_input
import factdrift.staging as staging
import factdrift.operators.vertical as vertical
import pytest
from factdrift import mine_incremental, mine_triples, mine_vertical, plan_windows
from factdrift.operators.incremental import changed_bitmaps, updated_counts
from factdrift.operators.vertical import count_sets, next_candidates
from pyspark.sql import functions as F
from test_mining import brute_force, random_triples, values


def patched(monkeypatch, way):
    if way == "long":
        monkeypatch.setattr(mining_input, "MASK_WINDOWS", 2)
    if way == "shuffled":
        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(staging, "HEAVY_KEYS", 5)


@pytest.mark.parametrize("way", ["mask", "long", "shuffled"])
def test_bitmaps_against_brute_force(spark, monkeypatch, way):
    frame, rows = random_triples(spark, 3, 24, seed=5)
    expected = brute_force(rows, {k: {f"s{k:03}", f"s{k + 1:03}"} for k in range(2)}, 0.15, 0.4)
    assert max(len(s) for _, s in expected[0]) >= 3
    patched(monkeypatch, way)
    assert values(*mine_vertical(frame, plan_windows(frame, 2), 0.15, 0.4)) == expected


def test_more_entities_than_a_bucket_holds(spark):
    n = 70_000
    entity = F.concat(F.lit("e"), "id")
    facts = spark.range(n).select(
        entity.alias("subject"),
        F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("object"),
        F.lit("p").alias("predicate"),
        F.lit("iri").alias("object_kind"),
        F.lit("s").alias("snapshot"),
        F.lit("2020-01-01").cast("timestamp").alias("snapshot_ts"),
    )
    itemsets, rules = mine_vertical(facts, plan_windows(facts, 1), 0.3, 0.1)
    assert {tuple(r["items"]): r.freq for r in itemsets.collect()} == {("p=a",): n, ("p=b",): n // 2, ("p=a", "p=b"): n // 2}
    assert {r.rule_key: r.confidence for r in rules.collect()} == {"p=a => p=b": 0.5, "p=b => p=a": 1.0}


def test_candidates_have_only_frequent_subsets(spark):
    pairs = [[1, 2], [1, 3], [2, 3], [2, 4], [3, 4], [5, 6]]
    level = spark.createDataFrame([(0, p) for p in pairs] + [(1, [1, 2]), (1, [1, 3])], "window_id int, ids array<long>")
    assert [(r.window_id, r.ids) for r in next_candidates(level, 3).orderBy("ids").collect()] == [(0, [1, 2, 3]), (0, [2, 3, 4])]


def test_sets_without_common_bits_are_not_counted(spark):
    bits = spark.createDataFrame([(0, 1, 1, 5), (0, 2, 1, 6), (0, 3, 2, 5), (0, 1, 2, 5)], "window_id int, item_id long, bucket long, n long")
    maps = bits.groupBy("window_id", "item_id", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    sets = spark.createDataFrame([(0, [1, 2]), (0, [1, 3])], "window_id int, ids array<long>")
    assert {(tuple(r.ids), r.freq) for r in count_sets(maps, sets, 2, 2).collect()} == {((1, 2), 0), ((1, 3), 1)}


@pytest.mark.parametrize("way", ["mask", "long", "shuffled"])
def test_differences_against_brute_force(spark, monkeypatch, way):
    frame, rows = random_triples(spark, 4, 18, seed=11)
    expected = brute_force(rows, {k: {f"s{k + i:03}" for i in range(3)} for k in range(2)}, 0.35, 0.4)
    assert max(len(s) for _, s in expected[0]) >= 2
    patched(monkeypatch, way)
    found = mine_incremental(frame, plan_windows(frame, 3), 0.35, 0.4)
    assert values(found.itemsets, found.rules) == expected


def test_a_window_without_facts_starts_anew(spark):
    frame, rows = random_triples(spark, 4, 12, seed=3)
    frame = frame.withColumn("object_kind", F.when(F.col("snapshot") == "s001", "literal").otherwise("iri"))
    found = mine_incremental(frame, plan_windows(frame, 1), 0.3, 0.5)
    assert values(found.itemsets, found.rules) == brute_force(
        [r for r in rows if r[2] != "s001"], {k: {f"s{k:03}"} for k in (0, 2, 3)}, 0.3, 0.5
    )


def test_work_follows_the_change(spark):
    """A thousand entities, of which one changes: the second window reads its facts only."""
    base = spark.range(1000).select(
        F.concat(F.lit("e"), "id").alias("subject"), "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    )
    moved = (F.col("id") == 7) & (F.col("s") == 1)
    facts = base.select(
        "subject",
        F.lit("iri").alias("object_kind"),
        F.concat(F.lit("s"), "s").alias("snapshot"),
        F.timestamp_add("DAY", "s", F.lit("2020-01-01").cast("timestamp")).alias("snapshot_ts"),
        F.explode(F.array(F.lit("x"), F.when(moved, "z").otherwise("y"), F.lit("w"))).alias("object"),
        F.lit("p").alias("predicate"),
    )
    plan = plan_windows(facts, 1)
    found = mine_incremental(facts, plan, 0.5, 0.5)
    work = {r.window_id: (r.changed_facts, r.recounted_sets) for r in found.work.collect()}
    # x and w stay, y goes; z is not frequent anywhere and is not looked at.
    assert work[1] == (3, 0)
    assert work[0][1] == 4
    again = mine_triples(facts, plan, 0.5, 0.5)
    key = ["window_id", "items", "freq"]
    assert sorted(found.itemsets.select(key).collect()) == sorted(again[0].select(key).collect())


@pytest.mark.parametrize("slice_sets", [1, 1 << 16])
def test_sets_of_several_sizes_in_slices(spark, monkeypatch, slice_sets):
    monkeypatch.setattr(vertical, "_SLICE_SETS", slice_sets)
    held = {1: {5, 6, 40_000}, 2: {6, 7, 40_000}, 3: {6}}
    rows = [(0, item, n) for item, ns in held.items() for n in ns]
    maps = vertical.bitmaps_of(spark.createDataFrame(rows, "window_id int, item_id long, number long"), "window_id")
    sets = spark.createDataFrame([(0, [1, 2]), (0, [1, 2, 3]), (0, [3]), (0, [2, 9])], "window_id int, ids array<long>")
    found = {tuple(r.ids): r.freq for r in vertical.count_sets(maps, sets, 4, 3).collect()}
    assert found == {(1, 2): 2, (1, 2, 3): 1, (3,): 1}


def test_counts_follow_bitmaps_of_the_changed(spark):
    rows = [(1, 1, 1, 1), (1, 2, 1, 0), (2, 1, 0, 1), (2, 2, 1, 1), (40_000, 1, 0, 1), (40_000, 2, 0, 1)]
    changes = spark.createDataFrame([(3, *row) for row in rows], "window_id int, number long, item_id long, was int, now int")
    kept = spark.createDataFrame([([1], 5), ([1, 2], 4), ([7, 8], 2)], "ids array<long>, freq long")
    found = updated_counts(kept, changed_bitmaps(changes), 3, 2).collect()
    assert {tuple(r.ids): r.freq for r in found} == {(1,): 7, (1, 2): 5, (7, 8): 2}
