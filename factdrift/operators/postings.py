"""Rules by the items of their antecedents: which rules apply to a set of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, weighted_join

# Assumed size of an item's or a list entry's numbers in a broadcast table, next to its text.
_ENTRY_BYTES = 64


def rule_postings(rules: DataFrame) -> DataFrame:
    """``item, rule_key, consequent, n_items``: a row for each item of a rule's antecedent.

    ``rules`` has ``rule_key, antecedent, consequent``; a rule that is there several times
    counts once.
    """
    distinct = rules.select("rule_key", F.array_distinct("antecedent").alias("antecedent"), "consequent").dropDuplicates(
        ["rule_key"]
    )
    return distinct.select(
        F.explode("antecedent").alias("item"), "rule_key", "consequent", F.size("antecedent").alias("n_items")
    )


def applicable_rules(sets: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """``keys, rule_key, consequent``: the rules whose whole antecedent a set holds.

    ``sets`` has one row for each ``item`` of a set, which ``keys`` name. Only items that
    some antecedent has are gathered, as numbers, once for each set. A rule is looked up by
    the rarest item of its antecedent and compared with the sets that hold that one, where
    they are: neither hits nor candidates are shuffled. Items that occur in many sets do not
    meet in one task.
    """
    postings = stage(rule_postings(rules), "rule-postings").frame
    # How often an item occurs bounds how often it is looked up.
    occurrences = sets.groupBy("item").agg(F.count("*").alias("weight"))
    wanted = postings.select("item").distinct().join(occurrences, "item")
    numbers = stage(wanted.withColumn("item_id", F.monotonically_increasing_id()), "posting-items").frame
    found = numbers.agg(
        F.coalesce(F.sum(F.octet_length("item") + _ENTRY_BYTES), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("rows"),
    ).first()
    by_rarity = F.sort_array(F.collect_list(F.struct("weight", "item_id")))
    lists = stage(
        postings.join(numbers, "item")
        .groupBy("rule_key", "consequent", "n_items")
        .agg(by_rarity.alias("members"))
        .where(F.size("members") == F.col("n_items"))
        .select(
            F.col("members")[0].alias("rarest"),
            F.struct("rule_key", "consequent", F.col("members.item_id").alias("wanted")).alias("rule"),
        )
        .groupBy(F.col("rarest.item_id").alias("item_id"), F.col("rarest.weight").alias("weight"))
        .agg(F.collect_list("rule").alias("rules")),
        "posting-lists",
    ).frame
    totals = lists.agg(
        F.coalesce(F.sum(F.size("rules") * 4 * _ENTRY_BYTES), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("rows"),
    ).first()
    numbered = weighted_join(
        sets.select(*keys, "item"), numbers.select("item", "item_id", "weight"), ["item"], found["bytes"], found["rows"]
    )
    held = numbered.groupBy(*keys).agg(F.collect_set("item_id").alias("held"))
    looked_up = held.withColumn("item_id", F.explode("held"))
    candidates = weighted_join(looked_up, lists, ["item_id"], totals["bytes"], totals["rows"])
    whole = F.size(F.array_except("wanted", "held")) == 0
    return candidates.select(*keys, "held", F.inline("rules")).where(whole).select(*keys, "rule_key", "consequent")
