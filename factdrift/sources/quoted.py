"""Records of delimited text whose quoted cells may hold line breaks.

A file is read by line and split over tasks like any other. What a line does to the state
"inside quotes" is one of four functions of the state it starts in: it keeps it, turns it
round, or ends inside or outside whatever it was. A part of a file is the composition of
its lines, parts are composed in order of their place, and then every line knows whether
it goes on with a record or begins one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_INSIDE = r'(?:[^"]++|"")*+'


def _ends_inside(value: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it starts outside and if it starts inside.

    A cell is quoted if it starts with a quote; other quotes are text.
    """
    sep = re.escape(delimiter)
    closed = rf'"{_INSIDE}"[^{sep}]*+'
    opens = rf'(?:(?:{closed}|(?!")[^{sep}]*+){sep})*+"{_INSIDE}\z'
    quoted = F.contains(value, F.lit('"'))
    outside = quoted & value.rlike(rf"(?s)\A{opens}")
    inside = ~quoted | value.rlike(rf'(?s)\A{_INSIDE}\z') | value.rlike(rf'(?s)\A{_INSIDE}"[^{sep}]*+{sep}{opens}')
    return outside, inside


def _scan(frame: DataFrame, parts: list[str], order: list[str]) -> DataFrame:
    """Add ``known, state``: the composition of ``_fixed, _turned`` up to each row."""
    window = W.partitionBy(*parts).orderBy(*order)
    counted = frame.withColumn("_turns", F.sum("_turned").over(window))
    fixed = F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("state"), F.col("_turns").alias("turns")))
    last = counted.withColumn("_last", F.last(fixed, ignorenulls=True).over(window))
    odd = (F.col("_turns") - F.coalesce("_last.turns", F.lit(0))) % 2 == 1
    return last.withColumns(
        {"known": F.col("_last").isNotNull(), "state": odd != F.coalesce("_last.state", F.lit(False))}
    ).drop("_turns", "_last")


def quoted_records(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """``file, value``: the records of ``lines`` (file, start, row, value).

    ``start`` is where a line's part of the file begins and ``row`` orders lines within a
    part. Lines of one record are joined by a line feed, whatever parted them. A part is
    as large as Spark makes the splits of files; of a record, only the lines themselves
    are gathered. A quote that is never closed makes the rest of its file one record.
    """
    outside, inside = _ends_inside(F.col("value"), delimiter)
    part = ["file", "start"]
    steps = (
        lines.withColumns({"_a": outside, "_b": inside})
        .withColumns(
            {
                "_fixed": F.when(F.col("_a") == F.col("_b"), F.col("_a")),
                "_turned": (F.col("_a") & ~F.col("_b")).cast("int"),
            }
        )
        .drop("_a", "_b")
    )
    # The state before a line: known, or as that before the part, or the other one.
    after = _scan(steps, part, ["row"])
    in_part = W.partitionBy(*part).orderBy("row")
    lagged = after.withColumns(
        {
            "_known": F.lag("known", 1, False).over(in_part),
            "_state": F.lag("state", 1, False).over(in_part),
        }
    )
    summary = lagged.groupBy(*part).agg(
        F.max_by(F.struct("known", "state"), "row").alias("all"),
        F.count_if(~F.col("_state")).alias("_from_outside"),
        F.count_if(F.when(F.col("_known"), ~F.col("_state")).otherwise(F.col("_state"))).alias("_from_inside"),
    )
    # From here on one row for each part of a file.
    in_file = W.partitionBy("file").orderBy("start")
    composed = _scan(
        summary.withColumns(
            {
                "_fixed": F.when(F.col("all.known"), F.col("all.state")),
                "_turned": (~F.col("all.known") & F.col("all.state")).cast("int"),
            }
        ),
        ["file"],
        ["start"],
    )
    entered = composed.withColumn("inside", F.lag("state", 1, False).over(in_file))
    begun = entered.withColumn("begun", F.when(F.col("inside"), F.col("_from_inside")).otherwise(F.col("_from_outside")))
    earlier = F.last(F.when(F.col("begun") > 0, F.struct(F.col("start").alias("part"), F.col("begun").alias("number"))), ignorenulls=True)
    parts = begun.withColumn("open", earlier.over(in_file.rowsBetween(W.unboundedPreceding, -1))).select(
        *part, "inside", "begun", "open"
    )
    known_state = F.when(F.col("_known"), F.col("_state")).otherwise(F.col("_state") != F.col("inside"))
    numbered = (
        lagged.join(parts, part)
        .withColumn("_begins", (~known_state).cast("int"))
        .withColumn("_number", F.sum("_begins").over(in_part))
    )
    own = F.struct(F.col("start").alias("part"), F.col("_number").alias("number"))
    placed = numbered.withColumn("record", F.when(F.col("_number") > 0, own).otherwise(F.col("open")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda line: line["value"]), "\n")
    # Records that neither begin a part nor end one are whole; the others meet their rest.
    pieces = placed.groupBy(*part, "record", "_number", "begun").agg(text.alias("value"))
    at_edge = (F.col("_number") == 0) | (F.col("_number") == F.col("begun"))
    whole = pieces.where(~at_edge).select("file", "value")
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda piece: piece["value"]), "\n"
    )
    edges = pieces.where(at_edge).groupBy("file", "record").agg(joined.alias("value")).select("file", "value")
    return whole.unionByName(edges)
