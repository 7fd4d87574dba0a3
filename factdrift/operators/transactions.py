"""Transactions: the set of facts an entity has in one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import item_token
from ..sources.ntriples import LITERAL


def fact_items(triples: DataFrame, include_literals: bool = False) -> DataFrame:
    """Triples as items: the token ``predicate=object`` in column ``item``.

    Facts with literal objects are left out unless asked for.
    """
    if not include_literals:
        triples = triples.where(F.col("object_kind") != LITERAL)
    return triples.withColumn("item", item_token())


def build_transactions(windowed: DataFrame, include_literals: bool = False) -> DataFrame:
    """``window_id, subject, items``, with every distinct item of an entity.

    One entity's items are one array value here, which is what this operator
    is for; the mining plans do not go through it.
    """
    return (
        fact_items(windowed, include_literals)
        .groupBy("window_id", "subject")
        .agg(F.collect_set("item").alias("items"))
    )


def transaction_sizes(windowed: DataFrame, include_literals: bool = False) -> DataFrame:
    """``window_id, subject, n_items``: transactions counted, not gathered."""
    return (
        fact_items(windowed, include_literals)
        .select("window_id", "subject", "item")
        .distinct()
        .groupBy("window_id", "subject")
        .agg(F.count("*").alias("n_items"))
    )


def changed_entities(transactions: DataFrame) -> DataFrame:
    """Transactions of more than one item: facts that co-occur or changed."""
    return transactions.where(F.size("items") > 1)


def transactions_per_window(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("window_id").agg(F.count("*").alias("n_transactions"))
