"""One query per operator, over the driver's tables.

Results are flattened so that another engine can produce the same values: sets as
sorted joined strings, doubles rounded, integers as bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import factdrift as fd
from factdrift.functions import item_token, rule_key, short_label, unescape_literal
from factdrift.operators.snapshots import union_all
from factdrift.staging import scratch_path
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

WIDTH, STEP = 2, 1
MIN_SUPPORT, MIN_CONFIDENCE, TAU = 0.1, 0.5, 0.6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.customer_facts(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.order_facts(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part"))


def user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.user_facts(_table(spark, sf_dir, "events"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.document_facts(_table(spark, sf_dir, "documents"))


def flat(df: DataFrame) -> DataFrame:
    """Comparable values: see the module's description."""

    def plain(field: T.StructField) -> Column:
        column = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.LongType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.DoubleType):
                column = F.transform(column, lambda x: F.round(x * 1000000).cast("bigint"))
            column = F.array_join(column.cast("array<string>"), ",")
        return column.alias(field.name)

    return df.select(*(plain(field) for field in df.schema.fields))


def mined(facts: Callable[[SparkSession, str], DataFrame], width: int = WIDTH):
    def run(spark: SparkSession, sf_dir: str) -> fd.TemporalRules:
        return fd.temporal_rules(facts(spark, sf_dir), MIN_SUPPORT, MIN_CONFIDENCE, TAU, width, STEP)

    return run


customer_rules = mined(customer_facts)


def _lines(triples: DataFrame) -> DataFrame:
    return fd.render_lines(triples)


def _written(df: DataFrame, label: str, **options: str) -> str:
    """Write lines to the shared folder, for a query that reads files."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).text(path)
    return path


# --- sources -------------------------------------------------------------------


def s1_read_ntriples(spark, sf_dir):
    path = _written(_lines(document_facts(spark, sf_dir)), "documents-nt")
    return fd.read_ntriples(spark, path)


def s2_compressed_read(spark, sf_dir):
    path = _written(_lines(document_facts(spark, sf_dir)), "documents-bz2", compression="bzip2")
    return fd.read_ntriples(spark, f"{path}/*.bz2")


def s3_parse_lines(spark, sf_dir):
    return fd.parse_lines(_lines(document_facts(spark, sf_dir)))


def s4_object_kind(spark, sf_dir):
    parsed = s3_parse_lines(spark, sf_dir)
    return flat(parsed.groupBy("predicate", "object_kind").agg(F.count("*").alias("n")))


def s5_empty_to_null(spark, sf_dir):
    parsed = s3_parse_lines(spark, sf_dir)
    return flat(
        parsed.groupBy("predicate").agg(
            F.count("*").alias("n"),
            F.count("datatype").alias("n_datatype"),
            F.count("language").alias("n_language"),
        )
    )


def _with_noise(lines: DataFrame, sf_dir: str, malformed: bool) -> DataFrame:
    """Add a comment, a blank and optionally a broken line for every document."""
    texts = [F.concat(F.lit("# document "), F.col("doc_id").cast("string")), F.lit("  ")]
    if malformed:
        texts += [F.concat(F.lit("<doc/"), F.col("doc_id").cast("string"), F.lit("> no triple .")), F.lit("<a> <b> .")]
    documents = _table(lines.sparkSession, sf_dir, "documents")
    return lines.unionByName(documents.select(F.explode(F.array(*texts)).alias("value")))


def s6_line_filter(spark, sf_dir):
    lines = _with_noise(_lines(document_facts(spark, sf_dir)), sf_dir, malformed=True)
    return fd.parse_lines(lines)


def s6_line_counts(spark, sf_dir):
    """Lines of every kind, counted by the pass that parses them."""
    counts = Observation()
    lines = _with_noise(_lines(document_facts(spark, sf_dir)), sf_dir, malformed=True)
    parsed = fd.read_ntriples(spark, _written(lines.select("value"), "noisy-nt"), observation=counts)
    parsed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counts.get], "n_lines long, n_triples long, n_skipped long, n_malformed long")


def s7_failfast(spark, sf_dir):
    lines = _with_noise(_lines(document_facts(spark, sf_dir)), sf_dir, malformed=False)
    return fd.parse_lines(lines, mode="failfast")


def s7_refuses_malformed(spark, sf_dir):
    """Triples per predicate, and whether lines with broken ones among them fail."""
    lines = _lines(document_facts(spark, sf_dir))
    broken = fd.parse_lines(_with_noise(lines, sf_dir, malformed=True), mode="failfast")
    try:
        broken.write.format("noop").mode("overwrite").save()
        refused = False
    except Exception as error:
        refused = "Malformed N-Triples line" in str(error)
    parsed = fd.parse_lines(lines, mode="failfast")
    counts = parsed.groupBy("predicate").agg(F.count("*").alias("n"))
    return flat(counts.withColumn("refused", F.lit(refused)))


def s8_unescape(spark, sf_dir):
    """Every character of every text as an escape, read back."""
    utf16 = F.hex(F.encode("text", "UTF-16BE"))
    escaped = F.regexp_replace(utf16, "(.{4})", r"\\u$1")
    documents = _table(spark, sf_dir, "documents")
    return documents.select("doc_id", unescape_literal(escaped).alias("text"))


def _store(spark, sf_dir) -> str:
    path = scratch_path(spark, "store")
    fd.write_store(customer_facts(spark, sf_dir), path, rebalance=True)
    return path


def s9_read_store(spark, sf_dir):
    return flat(fd.read_store(spark, _store(spark, sf_dir)))


def s10_pruned_read(spark, sf_dir):
    return flat(fd.read_store(spark, _store(spark, sf_dir), snapshots=["1997", "1998"]))


def s10_windowed_read(spark, sf_dir):
    """Every third day of the events' store; the calendar prunes the others at run time."""
    path = scratch_path(spark, "store")
    fd.write_store(user_facts(spark, sf_dir), path, rebalance=True)
    windowed = fd.assign_windows(fd.read_store(spark, path), 1, 3)
    return flat(windowed.groupBy("window_id", "snapshot").agg(F.count("*").alias("n")))


def s11_rules_file_summary(spark, sf_dir):
    """Texts with their line breaks, quoted, with a header and without; plain lines."""
    path = scratch_path(spark, "rule-files")
    documents = _table(spark, sf_dir, "documents")
    tables = documents.select(
        F.col("text").alias("rule"),
        F.col("n_chars").alias("Confidence"),
        (F.col("doc_id") % 7).alias("SUPPORT"),
    )
    tables.write.csv(path, header=True, escape='"')
    tables.select("rule", "SUPPORT").write.mode("append").csv(path, escape='"')
    _table(spark, sf_dir, "part").select("p_name").write.mode("append").text(path)
    lineitem = _table(spark, sf_dir, "lineitem").select("l_tax", F.col("l_discount").alias("support"))
    lineitem.write.mode("append").csv(path, header=True)
    return flat(fd.rules_file_summary(spark, path))


def _exported(spark, sf_dir, measures: Column) -> DataFrame:
    path = scratch_path(spark, "rule-export")
    part = _table(spark, sf_dir, "part")
    part.select(F.col("p_name").alias("head"), measures.alias("measures")).write.json(path)
    return fd.read_rule_export(spark, path)


def s12_rule_export(spark, sf_dir):
    """Measures as names and values, in files of lines, of one-line and of spread arrays."""

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))

    measures = F.array(
        entry("CwaConfidence", F.col("p_size") / 64),
        entry("HeadCoverage", F.col("p_retailprice")),
        entry("Support", F.lit(1)),
    )
    key = F.col("p_partkey")
    rules = _table(spark, sf_dir, "part").select(
        key, F.struct(F.col("p_name").alias("head"), key.alias("id"), measures.alias("measures")).alias("rule")
    )
    arrays = (
        rules.groupBy((key % 3).alias("layout"), F.floor(key / 500).alias("block"))
        .agg(F.collect_list("rule").alias("rules"))
    )
    layouts = [
        rules.where(key % 3 == 0).select(F.lit("lines").alias("file"), F.to_json("rule").alias("value")),
        arrays.where("layout = 1").select(F.lit("arrays"), F.to_json("rules")),
        arrays.where("layout = 2").select(
            F.concat(F.lit("spread-"), "block"), F.to_json("rules", {"pretty": "true"})
        ),
    ]
    path = scratch_path(spark, "rule-export")
    layouts[0].unionAll(layouts[1]).unionAll(layouts[2]).write.partitionBy("file").text(path)
    export = fd.read_rule_export(spark, path).select(
        F.try_variant_get("rule", "$.id", "long").alias("id"),
        F.try_variant_get("rule", "$.head", "string").alias("head"),
        "rule",
    )
    return flat(fd.rule_measures(export))


def s13_measure_extraction(spark, sf_dir):
    """Measures as a flat map, with the preferred ones missing or zero at times."""
    size = F.col("p_size")
    measures = F.struct(
        F.when(size <= 10, size / 64).alias("CwaConfidence"),
        F.when(size <= 20, F.lit(0.0)).otherwise(F.lit(0.5)).alias("confidence"),
        (size / 128).alias("PcaConfidence"),
        F.when(size > 30, size / 256).alias("headCoverage"),
        F.col("p_partkey").cast("double").alias("support"),
    )
    return flat(fd.rule_measures(_exported(spark, sf_dir, measures)))


# --- tagging, union, sinks -------------------------------------------------------


def n1_tag_snapshot(spark, sf_dir):
    return flat(fd.tag_snapshot(document_facts(spark, sf_dir), "2024", datetime(2024, 1, 1)))


def n2_ingest_snapshot(spark, sf_dir):
    path = _written(_lines(document_facts(spark, sf_dir)), "snapshot-nt")
    return flat(fd.ingest_snapshot(spark, path, "2024", datetime(2024, 1, 1)))


def snapshot_files(triples: DataFrame) -> dict[str, tuple[str, datetime]]:
    """Write triples as one folder of N-Triples per snapshot."""
    spark = triples.sparkSession
    path = scratch_path(spark, "snapshots-nt")
    _lines(triples).select("value", "snapshot").write.partitionBy("snapshot").text(path)
    found = fd.ordered_snapshots(triples).select("snapshot", "snapshot_ts").collect()
    return {r["snapshot"]: (f"{path}/snapshot={r['snapshot']}", r["snapshot_ts"]) for r in found}


def n3_ingest_snapshots(spark, sf_dir):
    sources = snapshot_files(customer_facts(spark, sf_dir))
    return flat(fd.ingest_snapshots(spark, sources))


def n4_write_store(spark, sf_dir):
    path = _store(spark, sf_dir)
    return flat(
        fd.read_store(spark, path).groupBy("snapshot", "snapshot_ts").agg(F.count("*").alias("n"))
    )


def n4_replace_snapshot(spark, sf_dir):
    """A store in which the facts of 1997 were written anew, twice, less those of one predicate."""
    path = _store(spark, sf_dir)
    anew = customer_facts(spark, sf_dir).where("snapshot = '1997' AND predicate <> 'segment'")
    for _ in range(2):
        fd.replace_snapshots(anew, path, rebalance=True)
    return flat(fd.read_store(spark, path))


def _summary(spark, sf_dir) -> DataFrame:
    return fd.run_pipeline(
        spark, "customers", customer_facts(spark, sf_dir), MIN_SUPPORT, MIN_CONFIDENCE, TAU, WIDTH, STEP
    )


def n5_summary_sink(spark, sf_dir):
    path = scratch_path(spark, "summaries")
    fd.write_summaries(_summary(spark, sf_dir), path)
    written = spark.read.csv(path, header=True)
    numbers = ("mean_confidence", "mean_support", "mean_abs_drift", "mean_persistence", "n_windows")
    counts = ("n_input_triples", "n_rules")
    return flat(
        written.select(
            "dataset",
            "status",
            "supports_temporal",
            *(F.col(name).cast("long").alias(name) for name in counts),
            *(F.col(name).cast("double").alias(name) for name in numbers),
        )
    )


def n6_rule_measures_sink(spark, sf_dir):
    path = scratch_path(spark, "rule-measures")
    lineitem = _table(spark, sf_dir, "lineitem")
    fd.write_rule_measures(
        lineitem.select(
            F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("support"),
            F.when(F.col("l_quantity") <= 40, F.col("l_discount")).alias("confidence"),
        ),
        path,
    )
    return flat(spark.read.csv(path, header=True, schema="support double, confidence double"))


# --- projections, filters --------------------------------------------------------


def p1_literal_filter(spark, sf_dir):
    facts = customer_facts(spark, sf_dir)
    kept = fd.fact_items(facts).withColumn("literals", F.lit(False))
    every = fd.fact_items(facts, include_literals=True).withColumn("literals", F.lit(True))
    return flat(kept.unionByName(every).select("literals", "subject", "item", "object_kind", "snapshot"))


def p2_item_token(spark, sf_dir):
    items = customer_facts(spark, sf_dir).select(item_token().alias("item"))
    return flat(items.groupBy("item").agg(F.count("*").alias("n")))


def _windowed(spark, sf_dir, width=WIDTH, step=STEP, include_partial=False):
    return fd.assign_windows(customer_facts(spark, sf_dir), width, step, include_partial)


def _transactions(spark, sf_dir):
    return fd.build_transactions(_windowed(spark, sf_dir))


def _sorted_items(transactions: DataFrame) -> DataFrame:
    return flat(transactions.withColumn("items", F.sort_array("items")))


def p3_window_slice(spark, sf_dir):
    return _sorted_items(_transactions(spark, sf_dir).where("window_id = 2"))


def p4_changed_entities(spark, sf_dir):
    transactions = fd.build_transactions(fd.assign_windows(user_facts(spark, sf_dir), 1))
    return flat(fd.transactions_per_window(fd.changed_entities(transactions)))


ANTECEDENT, CONSEQUENT = "orderStatus=O", "orderStatus=F"


def p5_rule_lookup(spark, sf_dir):
    metrics = customer_rules(spark, sf_dir).metrics
    return flat(
        fd.rules_with_items(metrics, ANTECEDENT, CONSEQUENT).select(
            "rule_key", "persistence_score", "confidence_drift"
        )
    )


def p5_applicable_rules(spark, sf_dir):
    """How many of a window's customers hold each rule's antecedent, of any size."""
    items = fd.fact_items(_windowed(spark, sf_dir)).select("window_id", "subject", "item")
    found = fd.applicable_rules(items, ["window_id", "subject"], customer_rules(spark, sf_dir).rules)
    return flat(found.groupBy("window_id", "rule_key").agg(F.count("*").alias("n_customers")))


def p6_persistence_label(spark, sf_dir):
    return flat(fd.persistence_label(customer_rules(spark, sf_dir).metrics).select("rule_key", "kind"))


def p7_short_label(spark, sf_dir):
    """Items whose objects are paths of a customer's segment and name."""
    facts = customer_facts(spark, sf_dir)
    paths = facts.withColumn("object", F.concat(F.lit("customer/"), "predicate", F.lit("/"), "object"))
    transactions = fd.build_transactions(fd.assign_windows(paths, 1), include_literals=True)
    return flat(
        transactions.select("window_id", "subject", F.array_sort(short_label("items")).alias("labels"))
    )


def p8_rule_columns(spark, sf_dir):
    return flat(customer_rules(spark, sf_dir).rules)


# --- joins, aggregations -----------------------------------------------------------


def _rows_in_windows(windowed: DataFrame) -> DataFrame:
    return flat(windowed.select("subject", "predicate", "object", "snapshot", "window_id"))


def j1_window_join(spark, sf_dir):
    return _rows_in_windows(_windowed(spark, sf_dir))


def a1_transactions(spark, sf_dir):
    return _sorted_items(_transactions(spark, sf_dir))


def a2_trajectories(spark, sf_dir):
    trajectories = fd.rule_trajectories(customer_rules(spark, sf_dir).rules)
    return flat(
        trajectories.select(
            "rule_key",
            F.col("obs.window_id").alias("windows"),
            F.col("obs.support").alias("supports"),
            F.col("obs.confidence").alias("confidences"),
        )
    )


def a3_transactions_per_window(spark, sf_dir):
    return flat(fd.transactions_per_window(fd.transaction_sizes(_windowed(spark, sf_dir))))


def a4_triples_per_snapshot(spark, sf_dir):
    return flat(fd.triples_per_snapshot(customer_facts(spark, sf_dir)))


def a5_distinct_terms(spark, sf_dir):
    return flat(fd.distinct_terms(order_facts(spark, sf_dir)))


def a6_triple_count(spark, sf_dir):
    return flat(fd.triple_count(order_facts(spark, sf_dir)))


def a7_distinct_windows(spark, sf_dir):
    sizes = fd.transaction_sizes(_windowed(spark, sf_dir))
    return flat(sizes.agg(F.count_distinct("window_id").alias("n_windows")))


def a8_quality(spark, sf_dir):
    return flat(fd.quality(customer_rules(spark, sf_dir).metrics))


# --- windows -------------------------------------------------------------------------


def w1_ordered_snapshots(spark, sf_dir):
    return flat(fd.ordered_snapshots(user_facts(spark, sf_dir)))


def _windows(width: int, step: int, include_partial: bool = False) -> Query:
    def run(spark, sf_dir):
        snapshots = fd.ordered_snapshots(customer_facts(spark, sf_dir))
        return flat(fd.build_windows(snapshots, width, step, include_partial))

    return run


def _refused(action: Callable[[], object]) -> bool:
    try:
        action()
    except ValueError:
        return True
    return False


def w4_argument_checks(spark, sf_dir):
    """Windows of the least width and step that are accepted; lesser ones are refused."""
    facts = user_facts(spark, sf_dir)
    for refused in ((0, 1), (-1, 1), (1, 0)):
        if not _refused(lambda a=refused: fd.assign_windows(facts, *a)):
            raise AssertionError(f"Accepted width and step {refused}.")
    windowed = fd.assign_windows(facts, 1, 1)
    return flat(windowed.groupBy("window_id", "snapshot").agg(F.count("*").alias("n_triples")))


def w5_assign_windows(spark, sf_dir):
    return _rows_in_windows(_windowed(spark, sf_dir))


def w7_tumbling_windows(spark, sf_dir):
    return _rows_in_windows(_windowed(spark, sf_dir, 2, 2, include_partial=True))


def w8_gapped_windows(spark, sf_dir):
    return _rows_in_windows(_windowed(spark, sf_dir, 1, 2))


# --- mining ----------------------------------------------------------------------------


def m1_build_transactions(spark, sf_dir):
    windowed = _windowed(spark, sf_dir)
    return _sorted_items(fd.build_transactions(windowed, include_literals=True))


def m2_itemsets(spark, sf_dir):
    return flat(customer_rules(spark, sf_dir).itemsets)


def m2_vertical_itemsets(spark, sf_dir):
    """Itemsets over the line items, by bitmaps."""
    facts = order_facts(spark, sf_dir)
    itemsets, _ = fd.mine_vertical(facts, fd.plan_windows(facts, WIDTH, STEP), MIN_SUPPORT, MIN_CONFIDENCE)
    return flat(itemsets)


def _rule_values(rules: DataFrame) -> DataFrame:
    return flat(rules.select("window_id", "rule_key", "confidence", "lift", "support"))


def m3_rules(spark, sf_dir):
    return _rule_values(mined(order_facts)(spark, sf_dir).rules)


def m4_rule_key(spark, sf_dir):
    backwards = customer_rules(spark, sf_dir).rules.select(
        F.reverse("antecedent").alias("antecedent"), "consequent"
    )
    keys = backwards.select(rule_key("antecedent", "consequent").alias("rule_key"))
    return flat(keys.groupBy("rule_key").agg(F.count("*").alias("n")))


def m5_every_window(spark, sf_dir):
    itemsets, rules = fd.mine(_windowed(spark, sf_dir), MIN_SUPPORT, MIN_CONFIDENCE, cut_ratio=0)
    found = itemsets.select("window_id", F.lit("itemset").alias("what")).unionAll(
        rules.select("window_id", F.lit("rule"))
    )
    return flat(found.groupBy("window_id", "what").agg(F.count("*").alias("n")))


def m6_mine_rules(spark, sf_dir):
    _, rules = fd.mine_rules(_transactions(spark, sf_dir), MIN_SUPPORT, MIN_CONFIDENCE)
    return _rule_values(rules)


def _incremental(spark, sf_dir) -> fd.IncrementalRules:
    facts = customer_facts(spark, sf_dir)
    return fd.mine_incremental(facts, fd.plan_windows(facts, 3, 1), MIN_SUPPORT, MIN_CONFIDENCE)


def m6_incremental_rules(spark, sf_dir):
    """Rules of windows that overlap, each from the one before."""
    return _rule_values(_incremental(spark, sf_dir).rules)


def m5_incremental_work(spark, sf_dir):
    """Facts that each window after the first reads to update its counts."""
    work = _incremental(spark, sf_dir).work
    return flat(work.where("window_id > 0").select("window_id", "changed_facts"))


def m7_mine(spark, sf_dir):
    _, rules = fd.mine(fd.assign_windows(user_facts(spark, sf_dir), WIDTH), MIN_SUPPORT, MIN_CONFIDENCE)
    return _rule_values(rules)


def m8_evolution(spark, sf_dir):
    """One window over all snapshots."""
    facts = user_facts(spark, sf_dir)
    n_snapshots = fd.ordered_snapshots(facts).count()
    found = fd.temporal_rules(facts, MIN_SUPPORT, MIN_CONFIDENCE, TAU, width=n_snapshots)
    return _rule_values(found.rules)


# --- set operations, order ---------------------------------------------------------------


def u1_union_snapshots(spark, sf_dir):
    facts = customer_facts(spark, sf_dir)
    reordered = facts.select(*reversed(facts.columns))
    return flat(union_all([facts, reordered, facts]))


def u2_union_windows(spark, sf_dir):
    itemsets, _ = fd.mine(_windowed(spark, sf_dir), MIN_SUPPORT, MIN_CONFIDENCE, cut_ratio=0)
    return flat(itemsets)


def u3_distinct(spark, sf_dir):
    return flat(user_facts(spark, sf_dir).select("snapshot", "snapshot_ts").distinct())


def o1_snapshot_order(spark, sf_dir):
    return flat(fd.ordered_snapshots(customer_facts(spark, sf_dir)).select("position", "snapshot"))


def o2_metrics_order(spark, sf_dir):
    return flat(customer_rules(spark, sf_dir).metrics.select("rule_key", "persistence_score"))


def o3_by_persistence(spark, sf_dir):
    ranked = fd.by_persistence(customer_rules(spark, sf_dir).metrics)
    return flat(ranked.select("rule_key", "persistence_score", "mean_confidence"))


def o4_top_rules(spark, sf_dir):
    rules = customer_rules(spark, sf_dir).rules
    return _rule_values(fd.top_rules(rules.withColumn("confidence", F.round("confidence", 6))))


# --- temporal metrics ------------------------------------------------------------------------


def _metric(*columns: str, facts=customer_facts) -> Query:
    def run(spark, sf_dir):
        return flat(mined(facts)(spark, sf_dir).metrics.select("rule_key", *columns))

    return run


def t11_inferred_windows(spark, sf_dir):
    found = customer_rules(spark, sf_dir)
    return flat(fd.compute_metrics(found.rules, tau=TAU).select("rule_key", "temporal_support", "persistence_score"))


def t12_window_count(spark, sf_dir):
    """Metrics over the least number of windows that is accepted; lesser ones are refused."""
    rules = mined(user_facts)(spark, sf_dir).rules
    for refused in (0, -1):
        if not _refused(lambda n=refused: fd.compute_metrics(rules, n_windows=n)):
            raise AssertionError(f"Accepted {refused} windows.")
    metrics = fd.compute_metrics(rules, n_windows=1, tau=TAU)
    return flat(metrics.select("rule_key", "temporal_support", "persistence_score"))


def t13_merged_states(spark, sf_dir):
    """Metrics from the states of three stretches of windows, merged."""
    found = mined(user_facts)(spark, sf_dir)
    third = found.plan.n_windows // 3
    stretch = F.least(F.floor(F.col("window_id") / max(third, 1)), F.lit(2))
    first, second, last = (fd.rule_states(found.rules.where(stretch == k), TAU) for k in range(3))
    merged = fd.merge_states(fd.merge_states(first, second), last)
    return flat(fd.metrics_of_states(merged, found.plan.n_windows))


# --- evaluation --------------------------------------------------------------------------------


def e1_run_pipeline(spark, sf_dir):
    """From N-Triples files to the summary."""
    sources = snapshot_files(order_facts(spark, sf_dir))
    summary = fd.run_pipeline(spark, "orders", sources, MIN_SUPPORT, MIN_CONFIDENCE, TAU, WIDTH, STEP)
    return flat(summary.select("dataset", "n_input_triples", "n_rules", "mean_confidence", "mean_support"))


def e2_run_summary(spark, sf_dir):
    summary = _summary(spark, sf_dir)
    return flat(
        summary.select(
            "dataset",
            "status",
            "supports_temporal",
            "n_input_triples",
            "n_rules",
            "mean_confidence",
            "mean_support",
            "note",
            *(F.col("extra")[key].alias(key) for key in ("n_windows", "mean_persistence", "mean_abs_drift")),
        )
    )


def e3_throughput(spark, sf_dir):
    """Triples of a timed run, from its rate and its time."""
    rates = fd.throughput(_summary(spark, sf_dir))
    triples = F.round(F.col("triples_per_sec") * F.col("runtime_sec")).cast("long")
    return flat(rates.select("dataset", "n_input_triples", triples.alias("n_triples_in_time")))


def e4_temporal_summary(spark, sf_dir):
    return flat(fd.temporal_summary(_summary(spark, sf_dir)).drop("system"))


E5_RULES = {
    "persistent": ("orderStatus=O", "orderStatus=F"),
    "transient": ("orderStatus=F", "orderStatus=O"),
}


def e5_named_rules(spark, sf_dir):
    return flat(fd.named_rule_check(customer_rules(spark, sf_dir).metrics, E5_RULES))


_FUNCTIONS = (
    s1_read_ntriples,
    s2_compressed_read,
    s3_parse_lines,
    s4_object_kind,
    s5_empty_to_null,
    s6_line_filter,
    s6_line_counts,
    s7_failfast,
    s7_refuses_malformed,
    s8_unescape,
    s9_read_store,
    s10_pruned_read,
    s10_windowed_read,
    s11_rules_file_summary,
    s12_rule_export,
    s13_measure_extraction,
    n1_tag_snapshot,
    n2_ingest_snapshot,
    n3_ingest_snapshots,
    n4_write_store,
    n4_replace_snapshot,
    n5_summary_sink,
    n6_rule_measures_sink,
    p1_literal_filter,
    p2_item_token,
    p3_window_slice,
    p4_changed_entities,
    p5_rule_lookup,
    p5_applicable_rules,
    p6_persistence_label,
    p7_short_label,
    p8_rule_columns,
    j1_window_join,
    a1_transactions,
    a2_trajectories,
    a3_transactions_per_window,
    a4_triples_per_snapshot,
    a5_distinct_terms,
    a6_triple_count,
    a7_distinct_windows,
    a8_quality,
    w1_ordered_snapshots,
    w4_argument_checks,
    w5_assign_windows,
    w7_tumbling_windows,
    w8_gapped_windows,
    m1_build_transactions,
    m2_itemsets,
    m2_vertical_itemsets,
    m3_rules,
    m4_rule_key,
    m5_every_window,
    m5_incremental_work,
    m6_mine_rules,
    m6_incremental_rules,
    m7_mine,
    m8_evolution,
    u1_union_snapshots,
    u2_union_windows,
    u3_distinct,
    o1_snapshot_order,
    o2_metrics_order,
    o3_by_persistence,
    o4_top_rules,
    e1_run_pipeline,
    e2_run_summary,
    e3_throughput,
    e4_temporal_summary,
    e5_named_rules,
    t11_inferred_windows,
    t12_window_count,
    t13_merged_states,
)

QUERIES: dict[str, Query] = {
    **{query.__name__: query for query in _FUNCTIONS},
    "w2_build_windows": _windows(2, 1),
    "w3_partial_windows": _windows(2, 1, include_partial=True),
    "w6_window_sizes": _windows(3, 2, include_partial=True),
    "t1_observations": _metric("window_series", "confidence_series", facts=user_facts),
    "t2_series": _metric("window_series", "support_series", "confidence_series"),
    "t3_occurrences": _metric("occurrences"),
    "t4_first_last_window": _metric("first_window", "last_window"),
    "t5_temporal_support": _metric("temporal_support"),
    "t6_mean_confidence": _metric("mean_confidence"),
    "t7_confidence_drift": _metric("first_confidence", "last_confidence", "confidence_drift"),
    "t8_drift_rate": _metric("confidence_drift_rate"),
    "t9_volatility": _metric("confidence_volatility"),
    "t10_persistence": _metric("persistence_score"),
    "t12_all_metrics": lambda spark, sf_dir: flat(mined(user_facts)(spark, sf_dir).metrics),
}
