"""CSV sinks for run summaries and rule measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base columns of a run summary, in order.
SUMMARY_COLUMNS = (
    "system",
    "dataset",
    "status",
    "supports_temporal",
    "n_input_triples",
    "runtime_sec",
    "n_rules",
    "mean_confidence",
    "mean_support",
    "note",
)


def write_summaries(summaries: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """Write run summaries with every key of ``extra`` as a column of its own."""
    keys = summaries.select(F.explode(F.map_keys("extra")).alias("key")).distinct()
    extra = sorted(row["key"] for row in keys.collect())
    summaries.select(
        *SUMMARY_COLUMNS, *(F.try_element_at("extra", F.lit(key)).alias(key) for key in extra)
    ).write.mode(mode).csv(directory, header=True)


def write_rule_measures(rules: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """Write ``support,confidence`` rows; a missing value is an empty cell."""
    rules.select("support", "confidence").write.mode(mode).csv(directory, header=True)
