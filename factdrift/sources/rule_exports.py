"""Rules exported as JSON, and the measures attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread_json import array_elements

# Measure names in order of preference, lower case.
CONFIDENCE_MEASURES = ("cwaconfidence", "confidence", "pcaconfidence")
SUPPORT_MEASURES = ("headcoverage", "support")


def _parsed(texts: DataFrame) -> DataFrame:
    """Add ``document`` and ``is_json``, which is false for text after the value too.

    The parser stops at the end of the first value, so every text is parsed as
    part of an array that ends with the text's own hash.
    """
    mark = F.xxhash64("value")
    framed = F.concat(F.lit("["), "value", F.lit(","), mark.cast("string"), F.lit("]"))
    pair = F.try_variant_get(F.try_parse_json(framed), "$", "array<variant>")
    # The generator keeps the optimizer from parsing once more for every use.
    parsed = texts.select("*", F.explode(F.array(pair)).alias("_pair"))
    whole = (F.size("_pair") == 2) & (F.try_variant_get(F.get("_pair", 1), "$", "bigint") == mark)
    return parsed.select(
        *texts.columns,
        F.get("_pair", 0).alias("document"),
        F.coalesce(whole, F.lit(False)).alias("is_json"),
    )


def read_rule_export(spark: SparkSession, path: str) -> DataFrame:
    """Read exported rules, one per row, in variant column ``rule``.

    A file holds JSON values on lines of their own or one value spread over
    lines, a value being an object or an array of objects. All lines of a file
    decide which of the two it is: a first pass looks for files with a line that
    is no JSON value. Files of lines and spread arrays are split over tasks, a
    spread object is one task. Anything that is not JSON fails the job.
    """
    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.text(path).select("value", file).where(F.col("value").rlike(r"\S"))
    # Names only, of files that the driver has listed anyway.
    broken = _parsed(lines).where(~F.col("is_json")).select("file").distinct()
    spread = [row["file"] for row in broken.collect()]
    if not spread:
        return _rules(_documents(lines))
    in_spread = F.col("file").isin(spread)
    placed = spark.read.text(path).select(
        "value",
        file,
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = placed.where(in_spread & F.col("value").rlike(r"\S"))
    # The first sign of a file says what it holds; one row for each file.
    first = F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("start", "row"))
    signs = placed.groupBy("file").agg(first.alias("sign")).collect()
    arrays = [row["file"] for row in signs if row["sign"] == "["]
    others = [row["file"] for row in signs if row["sign"] != "["]
    found = _rules(_documents(lines.where(~in_spread)))
    if others:
        whole = spark.read.text(path, wholetext=True).select("value", file)
        found = found.unionByName(_rules(_documents(whole.where(F.col("file").isin(others)))))
    if arrays:
        elements = array_elements(placed.where(F.col("file").isin(arrays)))
        found = found.unionByName(_documents(elements).select(F.col("document").alias("rule")))
    return found


def _documents(texts: DataFrame) -> DataFrame:
    error = F.raise_error(F.concat(F.lit("Not JSON: a text in "), "file")).cast("boolean")
    return _parsed(texts).where(F.when(F.col("is_json"), True).otherwise(error))


def _rules(documents: DataFrame) -> DataFrame:
    as_array = F.try_variant_get("document", "$", "array<variant>")
    return documents.select(F.explode(F.coalesce(as_array, F.array("document"))).alias("rule"))


def _measure(name: str) -> Column:
    """The last entry of that name, whatever the case it is written in."""
    named = F.filter("measures", lambda entry: F.lower(entry["name"]) == name)
    return F.try_variant_get(F.try_element_at(named, F.lit(-1))["value"], "$", "double")


def rule_measures(export: DataFrame) -> DataFrame:
    """``support`` and ``confidence`` of each exported rule, NULL if missing.

    Columns other than ``rule`` are kept.

    Measures are a list of ``{name, value}`` objects or a flat map, in the
    field ``measures`` or, without such a field, in the rule itself.
    """
    source = F.coalesce(F.try_variant_get("rule", "$.measures", "variant"), "rule")
    entry_list = F.try_variant_get(source, "$", "array<struct<name string, value variant>>")
    entry_map = F.map_entries(F.try_variant_get(source, "$", "map<string, variant>"))
    entries = F.coalesce(
        entry_list,
        F.transform(entry_map, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))),
    )
    confidence, plain, partial = (_measure(name) for name in CONFIDENCE_MEASURES)
    relative, absolute = (_measure(name) for name in SUPPORT_MEASURES)
    kept = [name for name in export.columns if name != "rule"]
    return export.select(*kept, entries.alias("measures")).select(
        *kept,
        F.coalesce(relative, absolute).alias("support"),
        F.coalesce(confidence, F.nullif(plain, F.lit(0.0)), partial).alias("confidence"),
    )
