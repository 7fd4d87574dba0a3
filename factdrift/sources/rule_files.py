"""Summaries of rule tables that other miners wrote as delimited text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import bounded_join, stage
from .quoted import quoted_records

_FILES = "*.{csv,tsv,txt}"
# What counts as a number; anything else in a measure column is ignored.
_NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf|infinity)\s*$"


# Size of a file's numbers in a broadcast layout, next to its name.
_LAYOUT_BYTES = 64


def _number(cell: Column) -> Column:
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def _layouts(lines: DataFrame, delimiter: str) -> DataFrame:
    """Per file: where its measures are, and whether every line is a row.

    ``confidence`` and ``support`` count cells from 1; 0 means no such column,
    and both are 0 in a file without header. A line of whole cells ends outside
    quotes, so if all lines are such, no quoted cell holds a line break.
    """
    sep = re.escape(delimiter)
    cell = rf'(?:"(?:[^"]++|"")*+"|[^"{sep}]*+)'
    first = F.min_by("value", F.struct("start", "row"))
    # At most one mark a file. With a set among them, the aggregates of a task's files are
    # objects in a hash table; the first line alone, being text, would have all lines sorted.
    broken_line = F.when(~F.col("value").rlike(rf"(?s)\A{cell}(?:{sep}{cell})*+\z"), F.lit(True))
    files = (
        lines.groupBy("file")
        .agg(first.alias("line"), F.collect_set(broken_line).alias("marks"))
        .select("file", "line", (F.size("marks") == 0).alias("by_line"))
    )
    # A first cell may be empty; the delimiter in front makes every match longer than nothing.
    cells = F.regexp_extract_all(
        F.concat(F.lit(delimiter), "line"), F.lit(rf"{sep}({cell})"), F.lit(1)
    )
    names = F.transform(cells, lambda c: F.lower(F.regexp_replace(c, r'^"?\s*|\s*"?$', "")))
    split_header = ~F.col("by_line") & (F.regexp_count("line", F.lit('"')) % 2 == 1)
    has_measure = F.col("line").rlike("(?i)support|confidence")
    broken = F.concat(F.lit("Line break in the header of "), "file")
    return files.withColumn("names", names).select(
        "file",
        F.when(split_header & has_measure, F.raise_error(broken).cast("boolean"))
        .otherwise(F.col("by_line"))
        .alias("by_line"),
        F.array_position("names", "confidence").cast("int").alias("confidence"),
        F.array_position("names", "support").cast("int").alias("support"),
    )


def rules_file_summary(spark: SparkSession, directory: str, delimiter: str = ",") -> DataFrame:
    """Count the rules in a folder and average their confidence and support.

    A file has a header if its first row names a ``support`` or ``confidence``
    column, in any case; without one its rows are only counted. Line breaks in
    quotes are part of their cell. All files are split over tasks; those that have
    such cells are gone through once more, for the records. A header that names a
    measure and has a line break on its first line is an error.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.option("pathGlobFilter", _FILES).text(directory)
    placed = lines.select(
        "value",
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    layouts = stage(_layouts(placed, delimiter), "rule-layouts")
    try:
        has_header = F.col("confidence") + F.col("support") > 0
        totals = layouts.frame.agg(
            F.count_if(has_header).alias("headers"),
            F.coalesce(F.max(F.greatest("confidence", "support")), F.lit(0)).alias("width"),
            F.coalesce(F.sum(F.octet_length("file") + _LAYOUT_BYTES), F.lit(0)).alias("bytes"),
        ).first()
        # Names only, of files that the driver has listed anyway.
        by_record = [row["file"] for row in layouts.frame.where(~F.col("by_line")).collect()]
        names = [f"c{i}" for i in range(max(1, totals["width"]))]
        schema = ", ".join(f"{name} string" for name in [*names, "raw"])
        options = {"sep": delimiter, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "raw"}
        blank = rf'\A(?:"\s*+"|\s|{re.escape(delimiter)})*+\z'
        rows = lines.where(~F.col("value").rlike(blank)).select(
            F.from_csv("value", schema, options).alias("cells"), file.alias("file")
        )
        if by_record:
            records = quoted_records(placed.where(F.col("file").isin(by_record)), delimiter)
            rows = rows.where(~file.isin(by_record)).unionByName(
                records.where(~F.col("value").rlike(blank)).select(
                    F.from_csv("value", schema, options).alias("cells"), "file"
                )
            )
        cells = F.array(*(F.col("cells")[name] for name in names))
        rules = bounded_join(
            rows.select(cells.alias("cells"), "file"),
            layouts.frame.drop("by_line"),
            ["file"],
            totals["bytes"],
            ["cells"],
        )
        # A header is a row without numbers; it is only taken from the count.
        found = rules.agg(
            (F.count("*") - totals["headers"]).alias("n_rules"),
            F.avg(_number(F.get("cells", F.col("confidence") - 1))).alias("mean_confidence"),
            F.avg(_number(F.get("cells", F.col("support") - 1))).alias("mean_support"),
        )
        return spark.createDataFrame([found.first()], found.schema)
    finally:
        layouts.drop()
