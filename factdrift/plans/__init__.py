from .evaluation import (
    SUMMARY_SCHEMA,
    TemporalRules,
    distinct_terms,
    named_rule_check,
    quality,
    run_pipeline,
    store_snapshots,
    temporal_rules,
    temporal_summary,
    throughput,
    triple_count,
    triples_per_snapshot,
)
from .facts import as_triples, customer_facts, document_facts, fact, order_facts, user_facts

__all__ = [
    "SUMMARY_SCHEMA",
    "TemporalRules",
    "as_triples",
    "customer_facts",
    "distinct_terms",
    "document_facts",
    "fact",
    "named_rule_check",
    "order_facts",
    "quality",
    "run_pipeline",
    "store_snapshots",
    "temporal_rules",
    "temporal_summary",
    "throughput",
    "triple_count",
    "triples_per_snapshot",
    "user_facts",
]
