"""Spans of texts: (kind, start, end) in code points, the end exclusive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def span_column(found: list[list[tuple]]) -> pa.Array:
    """Lists of (kind, start, end) or (kind, start, end, base)."""
    rows = [[dict(zip(("kind", "start", "end", "base"), span, strict=False)) for span in spans] for spans in found]
    return pa.array(rows, _ARROW)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(spans: Column, base: Column, kinds: list[str]) -> list[Column]:
    """Counts and digest of the ``base`` spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]
