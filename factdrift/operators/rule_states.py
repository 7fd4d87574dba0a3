"""Temporal metrics from states that merge, without the series of a rule.

A state says what a stretch of windows had of a rule. Two states of neighbouring stretches
make the state of both, so a new window is merged into what is known instead of following
every rule from its first window on. Merging is associative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .trajectories import DEFAULT_TAU

_RULE = ["rule_key", "antecedent", "consequent"]


def rule_states(rules: DataFrame, tau: float = DEFAULT_TAU) -> DataFrame:
    """The state of each rule over the windows of ``rules``."""
    named = rules.select(
        "rule_key",
        F.sort_array("antecedent").alias("antecedent"),
        F.sort_array("consequent").alias("consequent"),
        "window_id",
        "support",
        "confidence",
    )
    before = F.lag("confidence").over(W.partitionBy(*_RULE).orderBy("window_id"))
    return (
        named.withColumn("change", F.abs(F.col("confidence") - before))
        .groupBy(*_RULE)
        .agg(
            F.count("*").alias("occurrences"),
            F.min("window_id").alias("first_window"),
            F.max("window_id").alias("last_window"),
            F.sum("support").alias("support_sum"),
            F.sum("confidence").alias("confidence_sum"),
            F.min_by("confidence", "window_id").alias("first_confidence"),
            F.max_by("confidence", "window_id").alias("last_confidence"),
            F.coalesce(F.sum("change"), F.lit(0.0)).alias("change_sum"),
            F.count_if(F.col("confidence") >= F.lit(float(tau))).alias("confident"),
        )
    )


_SUMS = ["occurrences", "support_sum", "confidence_sum", "change_sum", "confident"]


def merge_states(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """States of a stretch of windows and of the one that follows it, as one.

    A rule whose windows are not all before its later ones is an error.
    """
    a, b = earlier.alias("a"), later.alias("b")
    both = a.join(b, _RULE, "full_outer")
    met = F.col("a.occurrences").isNotNull() & F.col("b.occurrences").isNotNull()
    overlap = F.concat(F.lit("States of overlapping windows: "), F.col("rule_key"))

    def total(name: str) -> Column:
        return F.coalesce(F.col(f"a.{name}"), F.lit(0)) + F.coalesce(F.col(f"b.{name}"), F.lit(0))

    step = F.when(met, F.abs(F.col("b.first_confidence") - F.col("a.last_confidence"))).otherwise(0.0)
    sums = {name: total(name) for name in _SUMS} | {"change_sum": total("change_sum") + step}
    in_order = ~met | (F.col("a.last_window") < F.col("b.first_window"))
    last_window = F.coalesce("b.last_window", "a.last_window")
    return both.select(
        *_RULE,
        sums["occurrences"].alias("occurrences"),
        F.coalesce("a.first_window", "b.first_window").alias("first_window"),
        F.when(in_order, last_window).otherwise(F.raise_error(overlap).cast("int")).alias("last_window"),
        sums["support_sum"].alias("support_sum"),
        sums["confidence_sum"].alias("confidence_sum"),
        F.coalesce("a.first_confidence", "b.first_confidence").alias("first_confidence"),
        F.coalesce("b.last_confidence", "a.last_confidence").alias("last_confidence"),
        sums["change_sum"].alias("change_sum"),
        sums["confident"].alias("confident"),
    )


def metrics_of_states(states: DataFrame, n_windows: int) -> DataFrame:
    """The metrics of ``compute_metrics``, without series, over ``n_windows`` windows."""
    if n_windows <= 0:
        raise ValueError("Metrics need at least one window.")
    n, steps = F.lit(float(n_windows)), F.col("occurrences") - 1

    def per_step(value: Column) -> Column:
        return F.when(steps > 0, value / steps).otherwise(0.0)

    drift = F.col("last_confidence") - F.col("first_confidence")
    return states.select(
        *_RULE,
        "occurrences",
        "first_window",
        "last_window",
        (F.col("support_sum") / n).alias("temporal_support"),
        (F.col("confidence_sum") / F.col("occurrences")).alias("mean_confidence"),
        "first_confidence",
        "last_confidence",
        drift.alias("confidence_drift"),
        per_step(drift).alias("confidence_drift_rate"),
        per_step(F.col("change_sum")).alias("confidence_volatility"),
        (F.col("confident") / n).alias("persistence_score"),
    )
