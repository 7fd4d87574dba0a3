from .csv_sinks import SUMMARY_COLUMNS, write_rule_measures, write_summaries
from .ntriples import (
    BLANK,
    IRI,
    LITERAL,
    TRIPLE_SCHEMA,
    parse_lines,
    read_ntriples,
    render_lines,
)
from .rule_exports import read_rule_export, rule_measures
from .rule_files import rules_file_summary
from .store import TEMPORAL_SCHEMA, read_store, replace_snapshots, write_store

__all__ = [
    "BLANK",
    "IRI",
    "LITERAL",
    "SUMMARY_COLUMNS",
    "TEMPORAL_SCHEMA",
    "TRIPLE_SCHEMA",
    "parse_lines",
    "read_ntriples",
    "read_rule_export",
    "read_store",
    "render_lines",
    "replace_snapshots",
    "rule_measures",
    "rules_file_summary",
    "write_rule_measures",
    "write_store",
    "write_summaries",
]
