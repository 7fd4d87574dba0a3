"""Near-duplicate vectors in cells: recall, growth of what is compared, crowded cells; hubs of links."""

import math

import numpy as np
import pytest
from factdrift.llm import common, vectors
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def planted(n, dimension=32, noise=0.2, seed=3):
    """``n`` unrelated vectors, a near copy of each fourth, cosines on both sides of 0.98."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dimension))
    return np.concatenate([base, base[::4] + noise * rng.standard_normal((len(base[::4]), dimension))])


def frame_of(spark, data, label=1):
    return spark.createDataFrame([(i, x.tolist(), label) for i, x in enumerate(data)], SCHEMA)


def linked(data):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = unit @ unit.T >= 0.98
    np.fill_diagonal(found, False)
    return found


def test_links_are_found(spark):
    data = planted(6000)
    truth = linked(data)
    assert 400 < truth.sum() / 2 < 1200
    rows = sorted(vectors.group(frame_of(spark, data)).collect(), key=lambda r: r.vec_id)
    found = np.array([r.n_links for r in rows])
    assert (found <= truth.sum(1)).all()  # none below the cosine, none counted twice
    assert found.sum() >= 0.99 * truth.sum()


def test_compared_pairs_grow_little_faster_than_rows():
    def pairs(n):
        data = np.random.default_rng(5).standard_normal((n, 32))
        unit = data / np.linalg.norm(data, axis=1, keepdims=True) * math.sqrt(32)
        plan = vectors.calibrated(n)
        named = vectors.cells(unit / math.sqrt(32), plan, plan.parts)
        return sum(int((np.unique(c, return_counts=True)[1] ** 2).sum()) for c in named.T)

    assert pairs(32_000) / pairs(4_000) < 8**1.4


def test_crowded_cells_are_cut_into_blocks(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((1, 16)) + 0.04 * rng.standard_normal((150, 16))
    truth = linked(data)
    distinct = vectors.classes(vectors.keyed(frame_of(spark, data)))
    matches = vectors.find_matches(distinct, block_rows=16).where("other is null").groupBy("node").agg(F.sum("linked").alias("n"))
    found = {r.node: r.n for r in matches.collect()}
    assert truth.sum() > 15_000
    assert [found.get(i, 0) for i in range(150)] == truth.sum(1).tolist()


def test_one_row_in_each_label_and_size(spark):
    rows = [(0, [1.0], 1), (1, [2.0], 1), (2, [1.0, 1.0], 1), (3, [1.0], 2), (4, [-1.0], 1)]
    found = {(r.vec_id, r.n_links, r.component_id) for r in vectors.group(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(0, 1, 0), (1, 1, 0), (2, 0, 2), (3, 0, 3), (4, 0, 4)}


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_components_of_a_hub(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr("factdrift.staging.BROADCAST_BYTES", broadcast_bytes)
    star = spark.range(1, 40_001, numPartitions=8).select(F.lit(50_000).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.range(60_000, 60_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = common.components(star.unionByName(path))
    sizes = {r.root: r["count"] for r in found.groupBy("root").count().collect()}
    assert sizes == {1: 40_001, 60_000: 41}


def test_a_hub_does_not_meet_in_one_task(spark, monkeypatch):
    """With nothing broadcast whole, the hub's links take the broadcast of hot keys."""
    monkeypatch.setattr("factdrift.staging.BROADCAST_BYTES", 0)
    star = spark.range(1, 40_001, numPartitions=8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
    joined = common.weighted_join(both.where("v > u"), least, ["u"], 1, 80_000)
    spread = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(spread) == 40_000 and max(spread) <= 10_000
