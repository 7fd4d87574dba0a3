"""Frequent itemsets and association rules per window.

MLlib's FP-Growth does the mining. It has no notion of a window, so an item is
encoded as one number per (window, item): itemsets cannot cross windows and
windows of similar size share a fit.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import rule_key
from ..staging import Staged, bounded_join, stage
from .mining_input import (
    DictionarySize,
    LongItems,
    MaskedItems,
    items_of_transactions,
    items_of_triples,
    items_of_windowed,
)
from .snapshots import union_all
from .windows import WindowPlan

# Windows whose cuts lie within this ratio share a fit. A shared fit mines down to
# the smallest cut, so the ratio bounds the itemsets found and dropped again.
CUT_RATIO = 2.0
# Assumed size of a row's numbers in a broadcast table, next to its text.
_ENTRY_BYTES = 64

# The columns of the results, in order.
_ITEMSETS = ["window_id", "items", "freq", "support"]
_RULES = ["window_id", "rule_key", "antecedent", "consequent", "confidence", "lift", "support"]


def _cohorts(cuts: dict[int, int], ratio: float) -> list[list[int]]:
    """Group windows by cut, none above ``ratio`` times the least of its group."""
    groups: list[list[int]] = []
    for window_id in sorted(cuts, key=cuts.get):
        if groups and cuts[window_id] <= ratio * cuts[groups[-1][0]]:
            groups[-1].append(window_id)
        else:
            groups.append([window_id])
    return groups


def _larger_itemsets(
    baskets: DataFrame, sizes: dict[int, int], least: int, n_items: int
) -> DataFrame | None:
    """FP-Growth over some windows' baskets, down to a count of ``least``."""
    total = sum(sizes.values())
    if total < least:
        return None
    parallelism = baskets.sparkSession.sparkContext.defaultParallelism
    model = FPGrowth(
        itemsCol="ids",
        # Half a transaction below the cut: rounding cannot move it.
        minSupport=(least - 0.5) / total,
        numPartitions=max(1, min(n_items, parallelism)),
    ).fit(baskets.where(F.col("window_id").isin(list(sizes))).select("ids"))
    return model.freqItemsets.where(F.size("items") > 1).select(
        F.sort_array("items").alias("ids"), "freq"
    )


def _mine(
    items: LongItems | MaskedItems,
    min_support: float,
    min_confidence: float,
    cut_ratio: float,
    tables: list[Staged] | None = None,
) -> tuple[DataFrame, DataFrame]:
    scrap, kept = [items.staged], []
    try:
        found = _mine_staged(items, min_support, min_confidence, cut_ratio, scrap, kept)
        if tables is not None:
            tables.extend(kept)
        return found
    except BaseException:
        scrap += kept
        raise
    finally:
        for staged in scrap:
            staged.drop()


def _mine_staged(
    items: LongItems | MaskedItems,
    min_support: float,
    min_confidence: float,
    cut_ratio: float,
    scrap: list[Staged],
    kept: list[Staged],
) -> tuple[DataFrame, DataFrame]:
    """Mine; tables the results read are added to ``kept``, others to ``scrap``."""
    spark = items.staged.frame.sparkSession
    # One row per window.
    n_tx = {row["window_id"]: row["n_transactions"] for row in items.sizes.collect()}
    if not n_tx:
        raise ValueError("No windows to mine: there are no transactions.")
    cuts = {w: max(1, math.ceil(min_support * n)) for w, n in n_tx.items()}
    windows = spark.createDataFrame(
        [(w, n, cuts[w]) for w, n in n_tx.items()], "window_id int, n_tx long, cut long"
    )

    frequent = bounded_join(
        items.counted(), windows, ["window_id"], _ENTRY_BYTES * len(n_tx), ["item"]
    ).where("freq >= cut")
    kept.append(stage(items.dictionary(frequent), "frequent-items"))
    dictionary = kept[-1].frame
    singles = items.singles(dictionary)
    totals = singles.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum(F.octet_length("item") + _ENTRY_BYTES), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("freq"), F.lit(0)).alias("occurrences"),
    ).first()
    size = DictionarySize(**totals.asDict())

    baskets = stage(items.baskets(dictionary, size), "baskets")
    scrap.append(baskets)
    found = _fits(baskets.frame, cuts, cut_ratio, size.items)

    known = singles.select(
        "window_id",
        F.array("item_id").alias("ids"),
        F.array("item").alias("items"),
        "freq",
        (F.col("freq") / F.col("n_tx")).alias("support"),
    )
    if found:
        known = known.unionByName(_decoded(union_all(found), singles, size.bytes))
    kept.append(stage(known, "itemsets"))
    itemsets = kept[-1].frame
    return itemsets.select(_ITEMSETS), _rules(itemsets, singles, size.bytes, min_confidence)


def _fits(
    baskets: DataFrame, cuts: dict[int, int], cut_ratio: float, n_items: int
) -> list[DataFrame]:
    """Fit the windows that have baskets, group by group."""
    counts = baskets.groupBy("window_id").agg(F.count("*").alias("n")).collect()
    sizes = {row["window_id"]: row["n"] for row in counts}
    fits = [
        _larger_itemsets(baskets, {w: sizes[w] for w in group}, cuts[group[0]], n_items)
        for group in _cohorts({w: cuts[w] for w in sizes}, cut_ratio)
    ]
    return [fit for fit in fits if fit is not None]


def _decoded(found: DataFrame, singles: DataFrame, dictionary_bytes: int) -> DataFrame:
    """Look the items of encoded itemsets up and apply each window's own cut."""
    members = bounded_join(
        found.withColumn("item_id", F.explode("ids")),
        singles.select("window_id", "item", "item_id", "n_tx", "cut"),
        ["item_id"],
        dictionary_bytes,
        ["ids"],
    )
    return (
        members.where("freq >= cut")
        .groupBy("window_id", "ids", "freq", "n_tx")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(
            "window_id", "ids", "items", "freq", (F.col("freq") / F.col("n_tx")).alias("support")
        )
    )


def _rules(
    itemsets: DataFrame, singles: DataFrame, dictionary_bytes: int, min_confidence: float
) -> DataFrame:
    """Split every itemset into an antecedent and each one-item consequent."""
    splits = itemsets.where(F.size("ids") > 1).select(
        "window_id", "ids", "support", F.col("freq").alias("n_both"), F.explode("ids").alias("item_id")
    )
    splits = splits.withColumn("ids", F.array_remove("ids", F.col("item_id")))
    antecedents = itemsets.select(
        "window_id", "ids", F.col("items").alias("antecedent"), F.col("freq").alias("n_antecedent")
    )
    confident = (
        splits.join(antecedents, ["window_id", "ids"])
        .withColumn("confidence", F.col("n_both") / F.col("n_antecedent"))
        .where(F.col("confidence") >= F.lit(float(min_confidence)))
    )
    consequents = singles.select(
        "window_id",
        "item_id",
        F.array("item").alias("consequent"),
        (F.col("freq") / F.col("n_tx")).alias("consequent_support"),
    )
    return (
        bounded_join(confident, consequents, ["window_id", "item_id"], dictionary_bytes, ["ids"])
        .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
        .withColumn("rule_key", rule_key("antecedent", "consequent"))
        .select(_RULES)
    )


def decoded_results(
    found: DataFrame, singles: DataFrame, singles_bytes: int, min_confidence: float
) -> tuple[DataFrame, DataFrame]:
    """Itemsets and rules of frequent sets ``window_id, ids, freq``.

    ``singles`` has ``window_id, item, item_id, freq, n_tx`` of the frequent items.
    """
    members = bounded_join(
        found.withColumn("item_id", F.explode("ids")),
        singles.select("window_id", "item", "item_id", "n_tx"),
        ["window_id", "item_id"],
        singles_bytes,
        ["ids"],
    )
    itemsets = stage(
        members.groupBy("window_id", "ids", "freq", "n_tx")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .withColumn("support", F.col("freq") / F.col("n_tx")),
        "itemsets",
    ).frame
    return itemsets.select(_ITEMSETS), _rules(itemsets, singles, singles_bytes, min_confidence)


def mine_rules(
    transactions: DataFrame,
    min_support: float = 0.3,
    min_confidence: float = 0.6,
    cut_ratio: float = CUT_RATIO,
) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets and rules of each window's transactions.

    An itemset is frequent in a window of n transactions if it occurs in at
    least ``ceil(min_support * n)`` of them. All arrays are sorted. ``cut_ratio``
    0 fits every window on its own, infinity all of them together.
    """
    items = items_of_transactions(transactions)
    return _mine(items, min_support, min_confidence, cut_ratio)


def mine(
    windowed: DataFrame,
    min_support: float = 0.3,
    min_confidence: float = 0.6,
    include_literals: bool = False,
    cut_ratio: float = CUT_RATIO,
) -> tuple[DataFrame, DataFrame]:
    """``mine_rules`` over window-tagged triples."""
    items = items_of_windowed(windowed, include_literals)
    return _mine(items, min_support, min_confidence, cut_ratio)


def mine_triples(
    triples: DataFrame,
    plan: WindowPlan,
    min_support: float = 0.3,
    min_confidence: float = 0.6,
    include_literals: bool = False,
    cut_ratio: float = CUT_RATIO,
    tables: list[Staged] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``mine_rules`` over temporal triples and the windows planned for them.

    The staged tables that the results read are added to ``tables``, for who
    wants to delete them.
    """
    items = items_of_triples(triples, plan, include_literals)
    return _mine(items, min_support, min_confidence, cut_ratio, tables)
