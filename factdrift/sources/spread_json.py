"""JSON arrays that are spread over lines, cut into their elements.

A file is read by line and split over tasks like any other. No JSON string holds a line
break, so every line starts outside of strings; how deep it starts is the sum of the
brackets before it. Commas at depth one part the elements, whose numbers are sums as well.
Sums are taken within the parts of a file and then over the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_TOKEN = rf'{_STRING}|[\[\]{{}},]|[^"\[\]{{}},]++|"'


def _sums_before(lines: DataFrame, column: str, name: str) -> DataFrame:
    """Add the sum of ``column`` over all lines of the file before each line."""
    part = ["file", "start"]
    in_part, in_file = W.partitionBy(*part).orderBy("row"), W.partitionBy("file").orderBy("start")
    # One row for each part of a file.
    parts = lines.groupBy(*part).agg(F.sum(column).alias("_n"))
    offsets = parts.select(*part, (F.sum("_n").over(in_file) - F.col("_n")).alias("_offset"))
    local = F.sum(column).over(in_part) - F.col(column)
    return lines.withColumn("_local", local).join(offsets, part).withColumn(name, F.col("_local") + F.col("_offset")).drop(
        "_local", "_offset"
    )


def _refused(condition: Column, value: Column) -> Column:
    """``value``, or an error where the condition does not hold."""
    error = F.raise_error(F.concat(F.lit("Not JSON: a text in "), "file"))
    return F.when(condition, value).otherwise(error.cast("string"))


def _pieces(value: Column, depth: Column) -> Column:
    """A line's part of each element: ``depth, ends, wrong, text, pieces``.

    ``ends`` counts the array's own brackets, ``wrong`` says that something stands outside.
    """
    start = F.struct(
        depth.cast("long").alias("depth"),
        F.lit(0).alias("ends"),
        F.lit(False).alias("wrong"),
        F.lit("").alias("text"),
        F.array().cast("array<string>").alias("pieces"),
    )

    def step(state: Column, token: Column) -> Column:
        d = state["depth"]
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        own = (opens & (d == 0)) | (closes & (d == 1))
        cut = (token == ",") & (d == 1)
        wrong = (own & ~token.isin("[", "]")) | (d < 0) | (~own & (d <= 0) & token.rlike(r"\S"))
        return F.struct(
            (d + F.when(opens, 1).when(closes, -1).otherwise(0)).cast("long").alias("depth"),
            (state["ends"] + own.cast("int")).alias("ends"),
            (state["wrong"] | wrong).alias("wrong"),
            F.when(cut, F.lit("")).when(own, state["text"]).otherwise(F.concat(state["text"], token)).alias("text"),
            F.when(cut, F.array_append(state["pieces"], state["text"])).otherwise(state["pieces"]).alias("pieces"),
        )

    return F.aggregate(F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0)), start, step)


def array_elements(lines: DataFrame) -> DataFrame:
    """``file, value``: the texts of the elements of each file's one array.

    ``lines`` has ``file, start, row, value``; ``start`` is where a line's part of the file
    begins, ``row`` orders lines within a part. An element is gathered, the array never is.
    Anything outside the array, an array that is not closed, and an empty element fail the
    job; an empty array has no elements.
    """
    bare = F.regexp_replace("value", rf"(?:{_STRING})++", "")
    net = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))
    placed = _sums_before(lines.withColumn("_net", net), "_net", "_depth")
    # A line that never gets as high as depth one is all of one element.
    lowest = F.aggregate(
        F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)),
        F.struct(F.col("_depth").alias("now"), F.col("_depth").alias("least")),
        lambda s, c: F.struct(
            (s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"),
            F.least(s["least"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("least"),
        ),
    )["least"]
    whole = F.struct(
        (F.col("_depth") + F.col("_net")).cast("long").alias("depth"),
        F.lit(0).alias("ends"),
        F.lit(False).alias("wrong"),
        F.col("value").alias("text"),
        F.array().cast("array<string>").alias("pieces"),
    )
    # The generator keeps the optimizer from going through a line once for every use.
    read = placed.select(
        "file", "start", "row", F.explode(F.array(F.when(lowest > 1, whole).otherwise(_pieces(F.col("value"), F.col("_depth"))))).alias("_s")
    ).withColumn("_cuts", F.size("_s.pieces"))
    numbered = _sums_before(read, "_cuts", "_first")
    pieces = numbered.select(
        "file", "start", "row", "_s.ends", "_s.wrong", "_first", F.posexplode(F.array_append("_s.pieces", F.col("_s.text"))).alias("_at", "piece")
    ).withColumn("number", F.col("_first") + F.col("_at"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("start", "row", "piece"))), lambda p: p["piece"])
    ends = F.sum(F.when(F.col("_at") == 0, F.col("ends")).otherwise(0))
    elements = pieces.groupBy("file", "number").agg(
        F.array_join(text, "\n").alias("value"), ends.alias("ends"), F.bool_or("wrong").alias("wrong")
    )
    # What is said about a file's elements together is one row for each file.
    files = elements.groupBy("file").agg(
        F.sum("ends").alias("all_ends"), F.bool_or("wrong").alias("any_wrong"), F.count("*").alias("elements")
    )
    sound = (F.col("all_ends") == 2) & ~F.col("any_wrong")
    joined = elements.select("file", "number", "value").join(files, "file")
    empty = (F.col("elements") == 1) & ~F.col("value").rlike(r"\S")
    checked = _refused(sound & (empty | F.col("value").rlike(r"\S")), F.col("value"))
    # In the order of the file, as lines are.
    return joined.withColumn("value", checked).where(~empty).orderBy("file", "number").select("file", "value")
