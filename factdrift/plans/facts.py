"""Relational tables shaped as temporal triples.

Each function takes table frames and returns the columns of a temporal triple. A
row yields its facts in place, so reshaping adds no shuffle to the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ntriples import BLANK, IRI, LITERAL


def fact(
    predicate: str,
    obj: Column,
    kind: str = IRI,
    datatype: str | None = None,
    language: Column | None = None,
) -> Column:
    """One fact about a row's subject."""
    missing = F.lit(None).cast("string")
    return F.struct(
        F.lit(predicate).alias("predicate"),
        obj.cast("string").alias("object"),
        F.lit(kind).alias("object_kind"),
        (missing if datatype is None else F.lit(datatype)).alias("datatype"),
        (missing if language is None else language).alias("language"),
    )


def as_triples(
    df: DataFrame,
    subject: Column,
    facts: list[Column],
    snapshot: Column | None = None,
    snapshot_ts: Column | None = None,
) -> DataFrame:
    """Turn every row of ``df`` into one triple per fact."""
    tags = []
    if snapshot is not None:
        tags = [snapshot.alias("snapshot"), snapshot_ts.cast("timestamp").alias("snapshot_ts")]
    return df.select(subject.alias("subject"), *tags, F.explode(F.array(*facts)).alias("_fact")).select(
        "subject", "_fact.*", *(["snapshot", "snapshot_ts"] if tags else [])
    )


def _subject(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def _by_year(time: str) -> dict[str, Column]:
    return {
        "snapshot": F.year(time).cast("string"),
        "snapshot_ts": F.make_date(F.year(time), F.lit(1), F.lit(1)),
    }


def customer_facts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """What a customer's orders were like, per order year; the name is a literal."""
    return as_triples(
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
        _subject("customer", "o_custkey"),
        [
            fact("orderStatus", F.col("o_orderstatus")),
            fact("orderPriority", F.col("o_orderpriority")),
            fact("segment", F.col("c_mktsegment")),
            fact("name", F.col("c_name"), LITERAL),
        ],
        **_by_year("o_orderdate"),
    )


def order_facts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """What an order shipped, per ship year."""
    return as_triples(
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")),
        _subject("order", "l_orderkey"),
        [
            fact("returnFlag", F.col("l_returnflag")),
            fact("lineStatus", F.col("l_linestatus")),
            fact("brand", F.col("p_brand")),
        ],
        **_by_year("l_shipdate"),
    )


def user_facts(events: DataFrame) -> DataFrame:
    """What a user did, per day."""
    day = F.to_date("ts")
    return as_triples(
        events,
        _subject("user", "user_id"),
        [fact("did", F.col("event_type"))],
        snapshot=day.cast("string"),
        snapshot_ts=day,
    )


def document_facts(documents: DataFrame) -> DataFrame:
    """A document's text, length, source and language, as four kinds of object."""
    return as_triples(
        documents,
        _subject("doc", "doc_id"),
        [
            fact("text", F.col("text"), LITERAL, language=F.col("lang")),
            fact("length", F.col("n_chars"), LITERAL, datatype="http://www.w3.org/2001/XMLSchema#integer"),
            fact("source", F.col("source")),
            fact("language", F.concat(F.lit("_:"), F.col("lang")), BLANK),
        ],
    )
