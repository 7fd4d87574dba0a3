from .incremental import IncrementalRules, mine_incremental
from .mining import mine, mine_rules, mine_triples
from .postings import applicable_rules, rule_postings
from .rule_states import merge_states, metrics_of_states, rule_states
from .snapshots import ingest_snapshot, ingest_snapshots, tag_snapshot, union_all
from .trajectories import (
    by_persistence,
    compute_metrics,
    persistence_label,
    rule_trajectories,
    rules_with_items,
    top_rules,
)
from .transactions import (
    build_transactions,
    changed_entities,
    fact_items,
    transaction_sizes,
    transactions_per_window,
)
from .vertical import mine_vertical
from .windows import (
    WindowPlan,
    assign_windows,
    build_windows,
    ordered_snapshots,
    plan_windows,
    window_spans,
)

__all__ = [
    "IncrementalRules",
    "WindowPlan",
    "applicable_rules",
    "assign_windows",
    "build_transactions",
    "build_windows",
    "by_persistence",
    "changed_entities",
    "compute_metrics",
    "fact_items",
    "ingest_snapshot",
    "ingest_snapshots",
    "merge_states",
    "metrics_of_states",
    "mine",
    "mine_incremental",
    "mine_rules",
    "mine_triples",
    "mine_vertical",
    "ordered_snapshots",
    "persistence_label",
    "plan_windows",
    "rule_postings",
    "rule_states",
    "rule_trajectories",
    "rules_with_items",
    "tag_snapshot",
    "top_rules",
    "transaction_sizes",
    "transactions_per_window",
    "union_all",
    "window_spans",
]
