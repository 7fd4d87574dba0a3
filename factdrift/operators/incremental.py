"""Mining windows that overlap by what changes from one to the next.

Counts of the frequent sets and of their border, the sets that just miss the cut, are kept
from window to window. An entity whose items are the same in both windows changes no
count; the facts of the others are laid out once, by window, and as bitmaps of who had and
who has an item; a window reads its own. Only sets that join the border are counted anew, by bitmaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staged, bounded_join, delete_at_exit, scratch_path, stage
from .mining import decoded_results
from .mining_input import LongItems, MaskedItems, items_of_triples
from .snapshots import union_all
from .vertical import Vertical, bitmaps_of, count_sets, next_candidates, vertical_items
from .windows import WindowPlan

WORK = "window_id int, changed_facts long, kept_sets long, recounted_sets long"


@dataclass(frozen=True)
class IncrementalRules:
    """Itemsets and rules, and what each window had to read and to count anew."""

    itemsets: DataFrame
    rules: DataFrame
    work: DataFrame


def _fact_windows(items: LongItems | MaskedItems) -> DataFrame:
    """``entity, item, windows``: each fact with the windows it is in, at most all there are."""
    if isinstance(items, MaskedItems):
        return items.staged.frame.select(F.col("subject").alias("entity"), "item", items.window_ids().alias("windows"))
    return items.rows.groupBy(F.col(items.entity).alias("entity"), "item").agg(F.collect_set("window_id").alias("windows"))


def changed_facts(items: LongItems | MaskedItems, vertical: Vertical) -> Staged:
    """``window_id, number, item_id, was, now``: facts of entities that differ from the window before.

    All of such an entity's facts in either window are there, of items that are frequent in
    any window; ``number`` stands for the entity. Stored by window.
    """
    numbers = vertical.singles.frame.groupBy("item").agg(F.first("item_id").alias("item_id"))
    facts = bounded_join(_fact_windows(items), numbers, ["item"], vertical.singles_bytes, ["entity"])
    later = F.transform("windows", lambda k: k + 1)
    facts = facts.select("entity", "item_id", "windows", later.alias("earlier"))
    differing = F.array_union(F.array_except("windows", "earlier"), F.array_except("earlier", "windows"))
    changed = (
        facts.select("entity", F.explode(differing).alias("window_id"))
        .distinct()
        .groupBy("entity")
        .agg(F.collect_list("window_id").alias("changed"))
        .withColumn("number", F.monotonically_increasing_id() + 1)
    )
    # Written before use, so a number stays with its entity.
    numbered = stage(changed, "changed-entities")
    either = F.array_intersect(F.array_union("windows", "earlier"), "changed")
    rows = facts.join(numbered.frame, "entity").select(
        "number", "item_id", "windows", "earlier", F.explode(either).alias("window_id")
    )
    table = rows.select(
        "number",
        "item_id",
        F.array_contains("earlier", F.col("window_id")).cast("int").alias("was"),
        F.array_contains("windows", F.col("window_id")).cast("int").alias("now"),
        "window_id",
    )
    spark = table.sparkSession
    path = scratch_path(spark, "changed-facts")
    table.hint("rebalance", "window_id").write.partitionBy("window_id").parquet(path)
    delete_at_exit(spark, path)
    numbered.drop()
    return Staged(spark.read.schema(table.schema).parquet(path), path)


def changed_bitmaps(changes: DataFrame) -> DataFrame:
    """``window_id, side, item_id, bucket, bits``: who of the changed had an item before, and who has it now."""
    sides = F.array_compact(F.array(F.when(F.col("was") == 1, 0), F.when(F.col("now") == 1, 1)))
    return bitmaps_of(changes.select("window_id", F.explode(sides).alias("side"), "item_id", "number"), "window_id", "side")


def updated_counts(kept: DataFrame, bitmaps: DataFrame, n_sets: int, width: int) -> DataFrame:
    """``ids, freq`` of the ``kept`` sets, of up to ``width`` items, after a window's changes.

    ``bitmaps`` has ``side, item_id, bucket, bits`` of the entities that changed. A set gains
    those that hold it now and loses those that held it before.
    """
    both = kept.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("window_id"), "ids")
    held = count_sets(bitmaps.withColumn("window_id", F.col("side")), both, 2 * n_sets, width)
    gained = F.when(F.col("window_id") == 1, F.col("freq")).otherwise(-F.col("freq"))
    deltas = held.groupBy("ids").agg(F.sum(gained).alias("delta"))
    return kept.join(deltas, "ids", "left").select(
        "ids", (F.col("freq") + F.coalesce("delta", F.lit(0))).alias("freq")
    )


def mine_incremental(
    triples: DataFrame,
    plan: WindowPlan,
    min_support: float = 0.3,
    min_confidence: float = 0.6,
    include_literals: bool = False,
) -> IncrementalRules:
    """The itemsets and rules of ``mine_triples``, window after window by differences.

    It pays where windows overlap and few entities change between them. Windows follow
    each other, so a run takes several small jobs for each; counts of sets are all that the
    driver sees.
    """
    spark = triples.sparkSession
    items = items_of_triples(triples, plan, include_literals)
    vertical = vertical_items(items, min_support)
    changes = changed_facts(items, vertical)
    # One row for each window, here and below.
    cuts = {r["window_id"]: r["cut"] for r in vertical.sizes.frame.collect()}
    n_facts = {r["window_id"]: r["count"] for r in changes.frame.groupBy("window_id").count().collect()}
    sides = stage(changed_bitmaps(changes.frame), "changed-bitmaps")
    scrap: list[Staged] = [items.staged, changes, sides, vertical.sizes, vertical.bitmaps]
    found = [vertical.singles.frame.select("window_id", F.array("item_id").alias("ids"), "freq")]
    work: list[tuple] = []
    kept, n_kept, width = None, 0, 0
    for window in range(plan.n_windows):
        if window not in cuts:
            # Without facts there are no counts to go on with.
            kept, n_kept, width = None, 0, 0
            continue
        n_changed = n_facts.get(window, 0) if kept is not None else 0
        if n_kept and n_changed:
            of_window = sides.frame.where(F.col("window_id") == window)
            scrap.append(stage(updated_counts(kept, of_window, n_kept, width), f"updated-{window}"))
            kept = scrap[-1].frame
        level = vertical.singles.frame.where(F.col("window_id") == window).select(
            "window_id", F.array("item_id").alias("ids"), "freq"
        )
        bitmaps = vertical.bitmaps.frame.where(F.col("window_id") == window)
        counted: list[DataFrame] = []
        size, n_counted, n_anew = 1, 0, 0
        while True:
            size += 1
            border = next_candidates(level, size)
            # Without a count where nothing is kept from the window before.
            marked = border.join(kept, "ids", "left") if n_kept else border.withColumn("freq", F.lit(None).cast("long"))
            scrap.append(stage(marked.select("window_id", "ids", "freq"), f"border-{window}-{size}"))
            known = scrap[-1].frame
            n_sets, n_new = known.agg(F.count("*"), F.count_if(F.col("freq").isNull())).first()
            if not n_sets:
                break
            if n_new:
                anew = known.where(F.col("freq").isNull()).select("window_id", "ids")
                counts = count_sets(bitmaps, anew, n_new, size)
                fresh = anew.join(counts, ["window_id", "ids"], "left").select(
                    "window_id", "ids", F.coalesce("freq", F.lit(0)).cast("long").alias("freq")
                )
                scrap.append(stage(known.where(F.col("freq").isNotNull()).unionByName(fresh), f"counted-{window}-{size}"))
            counted.append(scrap[-1].frame)
            level = counted[-1].where(F.col("freq") >= cuts[window])
            found.append(level)
            n_counted, n_anew, width = n_counted + n_sets, n_anew + n_new, size
        kept = union_all(counted).select("ids", "freq") if counted else spark.createDataFrame([], "ids array<long>, freq long")
        n_kept = n_counted
        work.append((window, n_changed, n_counted, n_anew))
    try:
        itemsets, rules = decoded_results(union_all(found), vertical.singles.frame, vertical.singles_bytes, min_confidence)
    finally:
        for table in scrap:
            table.drop()
    return IncrementalRules(itemsets, rules, spark.createDataFrame(work, WORK))
