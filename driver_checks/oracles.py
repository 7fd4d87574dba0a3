"""The same results as SQL over the driver's tables, independent of the engine.

Itemsets are found by listing the subsets of every distinct set of frequent items.
"""

from __future__ import annotations

CUSTOMER_FACTS = """
facts AS (
  SELECT 'customer/' || o_custkey AS subject, f.predicate, f.object, f.object_kind,
         CAST(year(o_orderdate) AS VARCHAR) AS snapshot,
         strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS snapshot_ts
  FROM orders JOIN customer ON o_custkey = c_custkey,
  LATERAL (VALUES ('orderStatus', o_orderstatus, 'iri'), ('orderPriority', o_orderpriority, 'iri'),
                  ('segment', c_mktsegment, 'iri'), ('name', c_name, 'literal')
          ) f(predicate, object, object_kind))"""

ORDER_FACTS = """
facts AS (
  SELECT 'order/' || l_orderkey AS subject, f.predicate, f.object, 'iri' AS object_kind,
         CAST(year(l_shipdate) AS VARCHAR) AS snapshot,
         strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS snapshot_ts
  FROM lineitem JOIN part ON l_partkey = p_partkey,
  LATERAL (VALUES ('returnFlag', l_returnflag), ('lineStatus', l_linestatus), ('brand', p_brand)
          ) f(predicate, object))"""

USER_FACTS = """
facts AS (
  SELECT 'user/' || user_id AS subject, 'did' AS predicate, event_type AS object, 'iri' AS object_kind,
         strftime(ts, '%Y-%m-%d') AS snapshot, strftime(ts, '%Y-%m-%d') AS snapshot_ts
  FROM events)"""

DOCUMENT_FACTS = """
facts AS (
  SELECT 'doc/' || doc_id AS subject, f.*
  FROM documents,
  LATERAL (VALUES
    ('text', text, 'literal', NULL, lang),
    ('length', CAST(n_chars AS VARCHAR), 'literal', 'http://www.w3.org/2001/XMLSchema#integer', NULL),
    ('source', source, 'iri', NULL, NULL),
    ('language', '_:' || lang, 'blank', NULL, NULL)
  ) f(predicate, object, object_kind, datatype, language))"""


def _windows(width: int = 2, step: int = 1, include_partial: bool = False) -> str:
    full = "true" if include_partial else f"w * {step} + {width} <= n"
    return f"""
calendar AS (
  SELECT snapshot, snapshot_ts, row_number() OVER (ORDER BY snapshot_ts, snapshot) - 1 AS position,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT snapshot, snapshot_ts FROM facts)),
members AS (
  SELECT w AS window_id, snapshot, position
  FROM calendar, generate_series(0, (SELECT count(*) FROM calendar)) g(w)
  WHERE position >= w * {step} AND position < w * {step} + {width} AND {full})"""


def _transactions(include_literals: bool = False) -> str:
    kept = "true" if include_literals else "object_kind <> 'literal'"
    return f"""
items AS (
  SELECT DISTINCT window_id, subject, predicate || '=' || object AS item
  FROM facts JOIN members USING (snapshot) WHERE {kept})"""


def _rules(min_support: float = 0.1, min_confidence: float = 0.5) -> str:
    return f"""
sizes AS (
  SELECT window_id, count(DISTINCT subject) AS n_tx,
         ceil({min_support}::DOUBLE * count(DISTINCT subject)) AS cut
  FROM items GROUP BY window_id),
singles AS (
  SELECT window_id, item, count(*) AS freq FROM items JOIN sizes USING (window_id)
  GROUP BY window_id, item, cut HAVING count(*) >= cut),
baskets AS (
  SELECT window_id, items, count(*) AS n
  FROM (SELECT window_id, subject, list(item ORDER BY item) AS items
        FROM items SEMI JOIN singles USING (window_id, item) GROUP BY window_id, subject)
  GROUP BY window_id, items),
subsets AS (
  SELECT window_id, items, n, [items[i]] AS subset, i AS last
  FROM baskets, LATERAL (SELECT unnest(generate_series(1, len(items)))) g(i)
  UNION ALL
  SELECT window_id, items, n, list_append(subset, items[j]), j
  FROM subsets, LATERAL (SELECT unnest(generate_series(last + 1, len(items)))) g(j)),
itemsets AS (
  SELECT window_id, subset AS items, CAST(sum(n) AS BIGINT) AS freq, sum(n) / n_tx AS support, n_tx
  FROM subsets JOIN sizes USING (window_id)
  GROUP BY window_id, subset, n_tx, cut HAVING sum(n) >= cut),
splits AS (
  SELECT window_id, list_filter(items, lambda x: x <> consequent) AS antecedent, consequent, freq, support, n_tx
  FROM itemsets, LATERAL (SELECT unnest(items)) g(consequent) WHERE len(items) > 1),
rules AS (
  SELECT s.window_id, array_to_string(s.antecedent, ',') || ' => ' || s.consequent AS rule_key,
         array_to_string(s.antecedent, ',') AS antecedent, s.consequent, s.freq / a.freq AS confidence,
         (s.freq / a.freq) / (c.freq / s.n_tx) AS lift, s.support
  FROM splits s
  JOIN itemsets a ON a.window_id = s.window_id AND a.items = s.antecedent
  JOIN singles c ON c.window_id = s.window_id AND c.item = s.consequent
  WHERE s.freq / a.freq >= {min_confidence})"""


def _metrics(tau: float = 0.6, n: str = "(SELECT count(DISTINCT window_id) FROM members)") -> str:
    return f"""
steps AS (
  SELECT *, abs(confidence - lag(confidence) OVER (PARTITION BY rule_key ORDER BY window_id)) AS change
  FROM rules),
metrics AS (
  SELECT rule_key, antecedent, consequent,
         array_to_string(list(window_id ORDER BY window_id), ',') AS window_series,
         array_to_string(list(CAST(round(support * 1000000) AS BIGINT) ORDER BY window_id), ',') AS support_series,
         array_to_string(list(CAST(round(confidence * 1000000) AS BIGINT) ORDER BY window_id), ',') AS confidence_series,
         count(*) AS occurrences, min(window_id) AS first_window, max(window_id) AS last_window,
         sum(support) / {n} AS temporal_support, avg(confidence) AS mean_confidence,
         arg_min(confidence, window_id) AS first_confidence, arg_max(confidence, window_id) AS last_confidence,
         arg_max(confidence, window_id) - arg_min(confidence, window_id) AS confidence_drift,
         CASE WHEN count(*) > 1
              THEN (arg_max(confidence, window_id) - arg_min(confidence, window_id)) / (count(*) - 1)
              ELSE 0 END AS confidence_drift_rate,
         coalesce(avg(change), 0) AS confidence_volatility,
         count(*) FILTER (confidence >= {tau}) / {n} AS persistence_score
  FROM steps GROUP BY rule_key, antecedent, consequent)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE" + ",".join(parts) + f"\n{select}"


def _mined(facts: str, select: str, width: int | str = 2, support: float = 0.1, tau: float = 0.6, n=None) -> str:
    parts = [facts, _windows(width), _transactions(), _rules(support)]
    parts.append(_metrics(tau, n) if n else _metrics(tau))
    return _with(*parts, select=select)


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({column}, 6) AS {column}" for column in columns)


def _metric(*columns: str, doubles: tuple[str, ...] = (), facts: str = CUSTOMER_FACTS) -> str:
    selected = ["rule_key", *columns]
    if doubles:
        selected.append(_rounded(*doubles))
    return _mined(facts, f"SELECT {', '.join(selected)} FROM metrics")


_DOCUMENTS = _with(DOCUMENT_FACTS, select="SELECT * FROM facts")
_FACT_COLUMNS = """SELECT subject, predicate, object, object_kind, CAST(NULL AS VARCHAR) AS datatype,
  CAST(NULL AS VARCHAR) AS language, snapshot, snapshot_ts FROM facts"""
_RULE_VALUES = f"SELECT window_id, rule_key, {_rounded('confidence', 'lift', 'support')} FROM rules"
_ITEMSETS = "SELECT window_id, array_to_string(items, ',') AS items, freq, round(support, 6) AS support FROM itemsets"
_TRANSACTIONS = """SELECT window_id, subject, string_agg(item, ',' ORDER BY item) AS items
  FROM items GROUP BY window_id, subject"""
_IN_WINDOWS = "SELECT subject, predicate, object, snapshot, window_id FROM facts JOIN members USING (snapshot)"
_WINDOW_LIST = """SELECT window_id, string_agg(snapshot, ',' ORDER BY position) AS snapshots, count(*) AS size
  FROM members GROUP BY window_id"""
_QUALITY = """count(*) AS n_rules, round(avg(mean_confidence), 6) AS mean_confidence,
  round(avg(temporal_support), 6) AS mean_support"""
_EXTRA = """round(avg(persistence_score), 6) AS mean_persistence,
  round(avg(abs(confidence_drift)), 6) AS mean_abs_drift"""
_N_WINDOWS = "CAST((SELECT count(DISTINCT window_id) FROM members) AS DOUBLE) AS n_windows"
_N_TRIPLES = "(SELECT count(*) FROM facts) AS n_input_triples"
_FOUND = """SELECT window_id, 'itemset' AS what, count(*) AS n FROM itemsets GROUP BY window_id
  UNION ALL SELECT window_id, 'rule', count(*) FROM rules GROUP BY window_id"""


def _customer(select: str, *parts: str) -> str:
    return _with(CUSTOMER_FACTS, *parts, select=select)


def _documents(select: str) -> str:
    return _with(DOCUMENT_FACTS, select=select)


_TAGGED = _documents("SELECT *, '2024' AS snapshot, '2024-01-01' AS snapshot_ts FROM facts")

ORACLES: dict[str, str] = {
    "s1_read_ntriples": _DOCUMENTS,
    "s2_compressed_read": _DOCUMENTS,
    "s3_parse_lines": _DOCUMENTS,
    "s4_object_kind": _documents(
        "SELECT predicate, object_kind, count(*) AS n FROM facts GROUP BY predicate, object_kind"
    ),
    "s5_empty_to_null": _documents(
        """SELECT predicate, count(*) AS n, count(datatype) AS n_datatype, count(language) AS n_language
        FROM facts GROUP BY predicate"""
    ),
    "s6_line_filter": _DOCUMENTS,
    "s6_line_counts": _documents(
        """SELECT count(*) + 4 * (SELECT count(*) FROM documents) AS n_lines, count(*) AS n_triples,
        2 * (SELECT count(*) FROM documents) AS n_skipped, 2 * (SELECT count(*) FROM documents) AS n_malformed
        FROM facts"""
    ),
    "s7_failfast": _DOCUMENTS,
    "s7_refuses_malformed": _documents(
        "SELECT predicate, count(*) AS n, true AS refused FROM facts GROUP BY predicate"
    ),
    "s8_unescape": "SELECT doc_id, text FROM documents",
    "s9_read_store": _customer(_FACT_COLUMNS),
    "s10_pruned_read": _customer(_FACT_COLUMNS + " WHERE snapshot IN ('1997', '1998')"),
    "s10_windowed_read": _with(
        USER_FACTS,
        _windows(1, 3),
        select="SELECT window_id, snapshot, count(*) AS n FROM facts JOIN members USING (snapshot) GROUP BY ALL",
    ),
    "s11_rules_file_summary": """SELECT
        (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM part) + 2 * (SELECT count(*) FROM documents)
          AS n_rules,
        (SELECT round(avg(n_chars), 6) FROM documents) AS mean_confidence,
        (SELECT round(avg(support), 6)
         FROM (SELECT l_discount AS support FROM lineitem UNION ALL SELECT doc_id % 7 FROM documents))
          AS mean_support""",
    "s12_rule_export": """SELECT p_partkey AS id, p_name AS head, round(p_retailprice, 6) AS support,
        round(p_size / 64, 6) AS confidence FROM part""",
    "s13_measure_extraction": """SELECT
        round(CASE WHEN p_size > 30 THEN p_size / 256 ELSE p_partkey END, 6) AS support,
        round(CASE WHEN p_size <= 10 THEN p_size / 64 WHEN p_size <= 20 THEN p_size / 128 ELSE 0.5::DOUBLE END, 6)
          AS confidence FROM part""",
    "n1_tag_snapshot": _TAGGED,
    "n2_ingest_snapshot": _TAGGED,
    "n3_ingest_snapshots": _customer(_FACT_COLUMNS),
    "n4_write_store": _customer("SELECT snapshot, snapshot_ts, count(*) AS n FROM facts GROUP BY ALL"),
    "n4_replace_snapshot": _customer(
        _FACT_COLUMNS + " WHERE snapshot <> '1997' OR predicate <> 'segment'"
    ),
    "n5_summary_sink": _mined(
        CUSTOMER_FACTS,
        f"""SELECT 'customers' AS dataset, 'ok' AS status, 'true' AS supports_temporal,
        {_N_TRIPLES}, {_QUALITY}, {_EXTRA}, {_N_WINDOWS} FROM metrics""",
    ),
    "n6_rule_measures_sink": """SELECT round(CASE WHEN l_quantity > 10 THEN l_tax END, 6) AS support,
        round(CASE WHEN l_quantity <= 40 THEN l_discount END, 6) AS confidence FROM lineitem""",
    "p1_literal_filter": _customer(
        """SELECT literals, subject, predicate || '=' || object AS item, object_kind, snapshot
        FROM facts, (VALUES (false), (true)) v(literals) WHERE literals OR object_kind <> 'literal'"""
    ),
    "p2_item_token": _customer("SELECT predicate || '=' || object AS item, count(*) AS n FROM facts GROUP BY item"),
    "p3_window_slice": _customer(
        f"SELECT * FROM ({_TRANSACTIONS}) WHERE window_id = 2", _windows(), _transactions()
    ),
    "p4_changed_entities": _with(
        USER_FACTS,
        _windows(1),
        _transactions(),
        select="""SELECT window_id, count(*) AS n_transactions
        FROM (SELECT window_id FROM items GROUP BY window_id, subject HAVING count(*) > 1) GROUP BY window_id""",
    ),
    "p5_rule_lookup": _mined(
        CUSTOMER_FACTS,
        f"""SELECT rule_key, {_rounded('persistence_score', 'confidence_drift')} FROM metrics
        WHERE antecedent = 'orderStatus=O' AND consequent = 'orderStatus=F'""",
    ),
    "p5_applicable_rules": _mined(
        CUSTOMER_FACTS,
        """SELECT held.window_id, rule_key, count(*) AS n_customers
        FROM (SELECT window_id, subject, list(item) AS held FROM items GROUP BY window_id, subject) held
        JOIN (SELECT DISTINCT rule_key, string_split(antecedent, ',') AS wanted FROM rules) named
          ON list_has_all(held.held, wanted)
        GROUP BY ALL""",
    ),
    "p6_persistence_label": _mined(
        CUSTOMER_FACTS,
        """SELECT rule_key, CASE WHEN occurrences > 1 THEN 'PERSISTENT' ELSE 'TRANSIENT' END AS kind
        FROM metrics""",
    ),
    "p7_short_label": _customer(
        """SELECT window_id, subject, string_agg(DISTINCT object, ',' ORDER BY object) AS labels
        FROM facts JOIN members USING (snapshot) GROUP BY window_id, subject""",
        _windows(1),
    ),
    "p8_rule_columns": _mined(
        CUSTOMER_FACTS,
        f"""SELECT window_id, rule_key, antecedent, consequent, {_rounded('confidence', 'lift', 'support')}
        FROM rules""",
    ),
    "j1_window_join": _customer(_IN_WINDOWS, _windows()),
    "a1_transactions": _customer(_TRANSACTIONS, _windows(), _transactions()),
    "a2_trajectories": _mined(
        CUSTOMER_FACTS,
        """SELECT rule_key, window_series AS windows, support_series AS supports,
        confidence_series AS confidences FROM metrics""",
    ),
    "a3_transactions_per_window": _customer(
        "SELECT window_id, count(DISTINCT subject) AS n_transactions FROM items GROUP BY window_id",
        _windows(),
        _transactions(),
    ),
    "a4_triples_per_snapshot": _customer("SELECT snapshot, count(*) AS n_triples FROM facts GROUP BY snapshot"),
    "a5_distinct_terms": _with(
        ORDER_FACTS,
        select="SELECT count(DISTINCT subject) AS n_entities, count(DISTINCT object) AS n_objects FROM facts",
    ),
    "a6_triple_count": _with(ORDER_FACTS, select="SELECT count(*) AS n_triples FROM facts"),
    "a7_distinct_windows": _customer("SELECT count(DISTINCT window_id) AS n_windows FROM members", _windows()),
    "a8_quality": _mined(CUSTOMER_FACTS, f"SELECT {_QUALITY}, {_EXTRA} FROM metrics"),
    "w1_ordered_snapshots": _with(
        USER_FACTS,
        _windows(),
        select="""SELECT position, snapshot, snapshot_ts, count(*) AS n_triples
        FROM calendar JOIN facts USING (snapshot, snapshot_ts) GROUP BY ALL""",
    ),
    "w2_build_windows": _customer(_WINDOW_LIST, _windows(2, 1)),
    "w3_partial_windows": _customer(_WINDOW_LIST, _windows(2, 1, True)),
    "w4_argument_checks": _with(
        USER_FACTS,
        _windows(1, 1),
        select="SELECT window_id, snapshot, count(*) AS n_triples FROM facts JOIN members USING (snapshot) GROUP BY ALL",
    ),
    "w5_assign_windows": _customer(_IN_WINDOWS, _windows()),
    "w6_window_sizes": _customer(_WINDOW_LIST, _windows(3, 2, True)),
    "w7_tumbling_windows": _customer(_IN_WINDOWS, _windows(2, 2, True)),
    "w8_gapped_windows": _customer(_IN_WINDOWS, _windows(1, 2)),
    "m1_build_transactions": _customer(_TRANSACTIONS, _windows(), _transactions(True)),
    "m2_itemsets": _mined(CUSTOMER_FACTS, _ITEMSETS),
    "m2_vertical_itemsets": _mined(ORDER_FACTS, _ITEMSETS),
    "m5_incremental_work": _mined(
        CUSTOMER_FACTS,
        """SELECT k AS window_id, count(*) AS changed_facts
        FROM (SELECT *, max(now <> was) OVER (PARTITION BY k, subject) AS changed
              FROM (SELECT k, subject, item, bool_or(now) AS now, bool_or(NOT now) AS was
                    FROM (SELECT window_id AS k, subject, item, true AS now FROM items SEMI JOIN singles USING (item)
                          UNION ALL
                          SELECT window_id + 1, subject, item, false FROM items SEMI JOIN singles USING (item))
                    GROUP BY k, subject, item))
        WHERE changed AND k > 0 AND k IN (SELECT window_id FROM sizes) GROUP BY k""",
        width=3,
    ),
    "m6_incremental_rules": _mined(CUSTOMER_FACTS, _RULE_VALUES, width=3),
    "m3_rules": _mined(ORDER_FACTS, _RULE_VALUES),
    "m4_rule_key": _mined(CUSTOMER_FACTS, "SELECT rule_key, count(*) AS n FROM rules GROUP BY rule_key"),
    "m5_every_window": _mined(CUSTOMER_FACTS, _FOUND),
    "m6_mine_rules": _mined(CUSTOMER_FACTS, _RULE_VALUES),
    "m7_mine": _mined(USER_FACTS, _RULE_VALUES),
    "m8_evolution": _mined(
        USER_FACTS, _RULE_VALUES, width="(SELECT count(DISTINCT snapshot) FROM facts)"
    ),
    "u1_union_snapshots": _customer(
        f"{_FACT_COLUMNS} UNION ALL {_FACT_COLUMNS} UNION ALL {_FACT_COLUMNS}"
    ),
    "u2_union_windows": _mined(CUSTOMER_FACTS, _ITEMSETS),
    "u3_distinct": _with(USER_FACTS, select="SELECT DISTINCT snapshot, snapshot_ts FROM facts"),
    "o1_snapshot_order": _customer("SELECT position, snapshot FROM calendar", _windows()),
    "o2_metrics_order": _metric(doubles=("persistence_score",)),
    "o3_by_persistence": _metric(doubles=("persistence_score", "mean_confidence")),
    "o4_top_rules": _mined(
        CUSTOMER_FACTS,
        f"SELECT * FROM ({_RULE_VALUES}) ORDER BY confidence DESC, rule_key, window_id LIMIT 15",
    ),
    "t1_observations": _metric("window_series", "confidence_series", facts=USER_FACTS),
    "t2_series": _metric("window_series", "support_series", "confidence_series"),
    "t3_occurrences": _metric("occurrences"),
    "t4_first_last_window": _metric("first_window", "last_window"),
    "t5_temporal_support": _metric(doubles=("temporal_support",)),
    "t6_mean_confidence": _metric(doubles=("mean_confidence",)),
    "t7_confidence_drift": _metric(doubles=("first_confidence", "last_confidence", "confidence_drift")),
    "t8_drift_rate": _metric(doubles=("confidence_drift_rate",)),
    "t9_volatility": _metric(doubles=("confidence_volatility",)),
    "t10_persistence": _metric(doubles=("persistence_score",)),
    "t11_inferred_windows": _mined(
        CUSTOMER_FACTS,
        f"SELECT rule_key, {_rounded('temporal_support', 'persistence_score')} FROM metrics",
        n="(SELECT count(DISTINCT window_id) FROM rules)",
    ),
    "t12_all_metrics": _metric(
        "antecedent",
        "consequent",
        "window_series",
        "support_series",
        "confidence_series",
        "occurrences",
        "first_window",
        "last_window",
        doubles=(
            "temporal_support",
            "mean_confidence",
            "first_confidence",
            "last_confidence",
            "confidence_drift",
            "confidence_drift_rate",
            "confidence_volatility",
            "persistence_score",
        ),
        facts=USER_FACTS,
    ),
    "e1_run_pipeline": _mined(
        ORDER_FACTS, f"SELECT 'orders' AS dataset, {_N_TRIPLES}, {_QUALITY} FROM metrics"
    ),
    "e2_run_summary": _mined(
        CUSTOMER_FACTS,
        f"""SELECT 'customers' AS dataset, 'ok' AS status, true AS supports_temporal, '' AS note,
        {_N_TRIPLES}, {_QUALITY}, {_EXTRA}, {_N_WINDOWS} FROM metrics""",
    ),
    "t13_merged_states": _metric(
        "antecedent",
        "consequent",
        "occurrences",
        "first_window",
        "last_window",
        doubles=(
            "temporal_support",
            "mean_confidence",
            "first_confidence",
            "last_confidence",
            "confidence_drift",
            "confidence_drift_rate",
            "confidence_volatility",
            "persistence_score",
        ),
        facts=USER_FACTS,
    ),
    "t12_window_count": _mined(
        USER_FACTS,
        f"SELECT rule_key, {_rounded('temporal_support', 'persistence_score')} FROM metrics",
        n="1",
    ),
    "e3_throughput": _customer(
        "SELECT 'customers' AS dataset, count(*) AS n_input_triples, count(*) AS n_triples_in_time FROM facts"
    ),
    "e4_temporal_summary": _mined(
        CUSTOMER_FACTS, f"SELECT 'customers' AS dataset, {_EXTRA}, {_N_WINDOWS} FROM metrics"
    ),
    "e5_named_rules": _mined(
        CUSTOMER_FACTS,
        f"""SELECT CASE antecedent WHEN 'orderStatus=O' THEN 'persistent' ELSE 'transient' END AS rule,
        {_rounded('persistence_score', 'confidence_drift')} FROM metrics
        WHERE (antecedent = 'orderStatus=O' AND consequent = 'orderStatus=F')
           OR (antecedent = 'orderStatus=F' AND consequent = 'orderStatus=O')""",
    ),
}
