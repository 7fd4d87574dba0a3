"""Frequent itemsets by bitmaps: who has an item, in bits, and level-wise candidates.

Entities are numbered and cut into buckets of 32,768. An item has one bitmap for each
window and bucket in which it occurs; a set of items is in as many transactions as bits
are left when its items' bitmaps are combined by AND. Neither items nor transactions are
gathered anywhere: a task holds the bitmaps of one bucket, 4 KB for each frequent item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staged, bounded_join, stage, weighted_join
from .mining import decoded_results
from .mining_input import LongItems, MaskedItems, items_of_triples
from .snapshots import union_all
from .windows import WindowPlan

# Assumed size of a row's numbers in a broadcast table, next to its text.
_ENTRY_BYTES = 64
# Sets that are counted in a bucket at once, about.
_SLICE_SETS = 1 << 16


@dataclass(frozen=True)
class Vertical:
    """Frequent items and their bitmaps.

    ``sizes`` has ``window_id, n_tx, cut``, ``singles`` the frequent items of each window
    with a number that is the same in all windows, ``bitmaps`` an item's bits for each
    window and bucket.
    """

    sizes: Staged
    singles: Staged
    bitmaps: Staged
    singles_bytes: int

    @property
    def tables(self) -> list[Staged]:
        return [self.sizes, self.singles, self.bitmaps]


def window_facts(items: LongItems | MaskedItems) -> DataFrame:
    """``window_id, entity, item``, one row for each item of a transaction."""
    if isinstance(items, LongItems):
        return items.rows.select("window_id", F.col(items.entity).alias("entity"), "item")
    return items.staged.frame.select(F.explode(items.window_ids()).alias("window_id"), F.col("subject").alias("entity"), "item")


def vertical_items(items: LongItems | MaskedItems, min_support: float) -> Vertical:
    """Count single items, number the frequent ones and lay out their bitmaps."""
    facts = window_facts(items)
    # One row for each window.
    cut = F.greatest(F.lit(1), F.ceil(F.lit(float(min_support)) * F.col("n_transactions"))).cast("long")
    sizes = stage(items.sizes.select("window_id", F.col("n_transactions").alias("n_tx"), cut.alias("cut")), "window-sizes")
    counted = facts.groupBy("window_id", "item").agg(F.count("*").alias("freq"))
    frequent = stage(counted.join(F.broadcast(sizes.frame), "window_id").where("freq >= cut"), "frequent-items")
    numbers = stage(frequent.frame.select("item").distinct().withColumn("item_id", F.monotonically_increasing_id()), "items")
    singles = stage(frequent.frame.join(numbers.frame, "item"), "numbered-items")
    totals = singles.frame.agg(
        F.coalesce(F.sum(F.octet_length("item") + _ENTRY_BYTES), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("freq"), F.lit(0)).alias("occurrences"),
    ).first()

    known = singles.frame.select("window_id", "item", "item_id", F.col("freq").alias("weight"))
    kept = weighted_join(facts, known, ["window_id", "item"], totals["bytes"], totals["occurrences"])
    # Dense within a partition, so entities that were counted together share buckets.
    entities = stage(kept.select("entity").distinct().withColumn("number", F.monotonically_increasing_id() + 1), "entities")
    laid = stage(bitmaps_of(kept.join(entities.frame, "entity"), "window_id"), "bitmaps")
    for table in (frequent, numbers, entities):
        table.drop()
    return Vertical(sizes, singles, laid, totals["bytes"])


def bitmaps_of(numbered: DataFrame, *keys: str) -> DataFrame:
    """``keys, item_id, bucket, bits`` of rows of ``keys, item_id, number``."""
    return numbered.groupBy(*keys, "item_id", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def next_candidates(level: DataFrame, size: int) -> DataFrame:
    """``window_id, ids``: sets of ``size`` items all of whose smaller sets are in ``level``.

    Two sets that differ in their last item make a candidate. ``level`` is as large as the
    frequent sets of one size, whatever the number of entities.
    """
    halves = level.select(
        "window_id", F.slice("ids", 1, size - 2).alias("head"), F.element_at("ids", -1).alias("last")
    )
    pairs = halves.join(halves.withColumnRenamed("last", "other"), ["window_id", "head"]).where("last < other")
    made = pairs.select("window_id", F.concat("head", F.array("last", "other")).alias("ids"))
    if size == 2:
        return made
    smaller = F.transform("ids", lambda item: F.array_remove("ids", item))
    subsets = made.select("window_id", F.col("ids").alias("set"), F.explode(smaller).alias("ids"))
    return (
        subsets.join(level.select("window_id", "ids"), ["window_id", "ids"])
        .groupBy("window_id", F.col("set").alias("ids"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == size)
        .select("window_id", "ids")
    )


def count_sets(bitmaps: DataFrame, sets: DataFrame, n_sets: int, size: int) -> DataFrame:
    """``window_id, ids, freq`` of ``sets`` of up to ``size`` items that share a bucket.

    Bitmaps of a bucket meet in one task with some of the sets, at most as many as
    ``_SLICE_SETS`` or so; only counts go on from there. Bitmaps are repeated for each
    slice of the sets, not for each set.
    """
    slices = max(1, -(-n_sets // _SLICE_SETS))
    cut = F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    at = ["window_id", "bucket", "slice"]
    # New names of the same, for the two sides of the cogroup are the same table otherwise.
    buckets = bitmaps.select(*(F.col(name).alias(name) for name in ("window_id", "bucket"))).distinct()
    set_bytes = n_sets * (_ENTRY_BYTES + 8 * size)
    asked = bounded_join(buckets, sets.select("window_id", "ids", cut), ["window_id"], set_bytes, ["bucket"])
    dealt = bitmaps.select("window_id", "bucket", "item_id", "bits", every)
    counted = dealt.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_bucket_counter(), "window_id int, ids array<long>, freq long")
    return counted.groupBy("window_id", "ids").agg(F.sum("freq").alias("freq"))


def _bucket_counter():
    """Counts the sets of a bucket by AND; made here, so executors need not have this package."""
    block = 256

    def count(maps, sets):
        import numpy as np
        import pyarrow as pa

        maps, sets = maps.combine_chunks(), sets.combine_chunks()
        found, freqs = [], []
        if len(maps) and len(sets):
            items = maps["item_id"].to_numpy()
            order = np.argsort(items)
            items = items[order]
            bits = np.frombuffer(b"".join(maps["bits"].to_pylist()), np.uint64).reshape(len(items), -1)
            lengths = sets["ids"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            members = sets["ids"].combine_chunks().flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for size in np.unique(lengths):
                some = np.flatnonzero(lengths == size)
                ids = members[starts[some][:, None] + np.arange(size)]
                place = np.minimum(np.searchsorted(items, ids), len(items) - 1)
                there = (items[place] == ids).all(1)
                some, place = some[there], order[place[there]]
                for first in range(0, len(some), block):
                    rows = place[first : first + block]
                    shared = bits[rows[:, 0]]
                    for k in range(1, size):
                        shared &= bits[rows[:, k]]
                    freqs.append(np.bitwise_count(shared).sum(1, dtype=np.int64))
                found.append(some)
        chosen = sets.take(pa.array(np.concatenate(found) if found else [], pa.int64()))
        freq = pa.array(np.concatenate(freqs) if freqs else [], pa.int64())
        return pa.table({"window_id": chosen["window_id"], "ids": chosen["ids"], "freq": freq})

    return count


def frequent_sets(vertical: Vertical) -> tuple[DataFrame, list[Staged]]:
    """``window_id, ids, freq`` of all frequent sets, and the tables that hold them."""
    sizes = F.broadcast(vertical.sizes.frame.select("window_id", "cut"))
    level = vertical.singles.frame.select("window_id", F.array("item_id").alias("ids"), "freq")
    found, tables, size = [level], [], 1
    while True:
        size += 1
        candidates = stage(next_candidates(level, size), f"candidates-{size}")
        tables.append(candidates)
        n_sets = candidates.frame.count()
        if not n_sets:
            return union_all(found), tables
        counted = count_sets(vertical.bitmaps.frame, candidates.frame, n_sets, size)
        tables.append(stage(counted.join(sizes, "window_id").where("freq >= cut").drop("cut"), f"frequent-{size}"))
        level = tables[-1].frame
        found.append(level)


def mine_vertical(
    triples: DataFrame,
    plan: WindowPlan,
    min_support: float = 0.3,
    min_confidence: float = 0.6,
    include_literals: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The itemsets and rules of ``mine_triples``, found by bitmaps.

    No item and no transaction passes through the driver or an array. It suits few
    frequent items and many entities; with long itemsets FP-Growth needs fewer passes.
    """
    items = items_of_triples(triples, plan, include_literals)
    vertical = vertical_items(items, min_support)
    found, scrap = frequent_sets(vertical)
    try:
        return decoded_results(found, vertical.singles.frame, vertical.singles_bytes, min_confidence)
    finally:
        for table in [items.staged, vertical.sizes, vertical.bitmaps, *scrap]:
            table.drop()
