"""Sliding windows that count snapshots.

Window ``k`` covers the snapshots at positions ``[k * step, k * step + width)`` in
temporal order, so the windows of one snapshot are a range of ids and no range
join is needed to find them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import BROADCAST_BYTES, stage, weighted_join

# Assumed size of one row of the snapshot calendar, ids included.
_CALENDAR_ROW_BYTES = 256
_DRIVER_ROWS = BROADCAST_BYTES // _CALENDAR_ROW_BYTES


def _check(width: int, step: int) -> None:
    if width < 1:
        raise ValueError("A window needs a width of one snapshot or more.")
    if step < 1:
        raise ValueError("Windows must advance by one snapshot or more.")


def _snapshots(df: DataFrame) -> DataFrame:
    """``snapshot, snapshot_ts, n_triples``, each snapshot once."""
    found = df.groupBy("snapshot").agg(
        F.min("snapshot_ts").alias("snapshot_ts"),
        F.max("snapshot_ts").alias("_latest"),
        F.count("*").alias("n_triples"),
    )
    ambiguous = F.concat(F.lit("Snapshot with more than one timestamp: "), "snapshot")
    return found.select(
        "snapshot",
        F.when(F.col("snapshot_ts").eqNullSafe(F.col("_latest")), F.col("snapshot_ts"))
        .otherwise(F.raise_error(ambiguous).cast("timestamp"))
        .alias("snapshot_ts"),
        "n_triples",
    )


_CALENDAR_SCHEMA = "position int, snapshot string, snapshot_ts timestamp, n_triples long"
_CALENDAR = [field.split()[0] for field in _CALENDAR_SCHEMA.split(", ")]
_LOCAL_BITS = 33


def ordered_snapshots(df: DataFrame) -> DataFrame:
    """Snapshots by timestamp, then id: ``position, snapshot, snapshot_ts, n_triples``.

    One pass with map-side combining; only one row per snapshot and task is
    shuffled. A snapshot id with two timestamps is an error.

    Snapshots are dealt to tasks by range and numbered within their task; a position is
    that number and the snapshots of the tasks before. Only the tasks' counts reach the
    driver, and the numbered rows are written, so a position stays what it is.
    """
    order = ["snapshot_ts", "snapshot"]
    dealt = _snapshots(df).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(dealt.withColumn("_place", F.monotonically_increasing_id()), "snapshots").frame
    numbered = numbered.withColumn("_task", F.shiftright("_place", _LOCAL_BITS))
    counts = numbered.groupBy("_task").agg(F.count("*").alias("n")).collect()
    tasks = sorted((row["_task"], row["n"]) for row in counts)
    before = accumulate((n for _, n in tasks), initial=0)
    starts = df.sparkSession.createDataFrame(
        [(task, start) for (task, _), start in zip(tasks, before)], "_task long, _start long"
    )
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    placed = numbered.join(F.broadcast(starts), "_task").withColumn("position", (F.col("_start") + local).cast("int"))
    return placed.select(_CALENDAR).orderBy("position")


def window_spans(
    snapshots: DataFrame,
    width: int,
    step: int = 1,
    include_partial: bool = False,
    n_snapshots: int | None = None,
) -> DataFrame:
    """Add ``first_window`` and ``last_window``, the ids of a snapshot's windows.

    ``first_window > last_window`` marks a snapshot in no window: one between
    windows (``step > width``) or in a tail too short for a full window.
    ``n_snapshots`` is counted where it is not given.
    """
    _check(width, step)
    total = F.lit(snapshots.count() if n_snapshots is None else n_snapshots)
    tail = F.lit(1 if include_partial else width)
    last = F.floor((total - tail) / step)
    return snapshots.withColumns(
        {
            "first_window": F.greatest(
                F.lit(0), F.ceil((F.col("position") - width + 1) / step)
            ).cast("int"),
            "last_window": F.least(last, F.floor(F.col("position") / step)).cast("int"),
        }
    )


def _window_ids() -> Column:
    """All windows of a snapshot; the guard keeps the range from running down."""
    return F.when(
        F.col("first_window") <= F.col("last_window"), F.sequence("first_window", "last_window")
    )


def build_windows(
    snapshots: DataFrame, width: int, step: int = 1, include_partial: bool = False
) -> DataFrame:
    """Windows over ordered snapshots: ``window_id, snapshots, size``.

    Only full windows are listed unless ``include_partial`` is set.
    """
    members = window_spans(snapshots, width, step, include_partial).select(
        F.explode(_window_ids()).alias("window_id"), "position", "snapshot"
    )
    in_order = F.sort_array(F.collect_list(F.struct("position", "snapshot")))
    return (
        members.groupBy("window_id")
        .agg(in_order.alias("_members"))
        .select(
            "window_id",
            F.col("_members.snapshot").alias("snapshots"),
            F.size("_members").alias("size"),
        )
    )


@dataclass(frozen=True)
class WindowPlan:
    """The windows of one analysis and the snapshots they cover.

    ``rows`` holds the spans while they fit the driver, else it is None.
    """

    spans: DataFrame
    rows: list | None
    n_snapshots: int
    n_windows: int
    n_triples: int


def plan_windows(
    df: DataFrame, width: int, step: int = 1, include_partial: bool = False
) -> WindowPlan:
    """Find the snapshots of ``df`` and lay windows over them, in one pass."""
    _check(width, step)
    found = _snapshots(df).limit(_DRIVER_ROWS + 1).collect()
    if len(found) <= _DRIVER_ROWS:
        # As Spark orders them: nulls first, ids by their bytes, as code points are.
        found.sort(key=lambda r: [(r[c] is not None, r[c]) for c in ("snapshot_ts", "snapshot")])
        calendar = [(k, r["snapshot"], r["snapshot_ts"], r["n_triples"]) for k, r in enumerate(found)]
        local = df.sparkSession.createDataFrame(calendar, _CALENDAR_SCHEMA)
        spans = window_spans(local, width, step, include_partial, len(found))
        rows = spans.collect()
        last = max((row["last_window"] for row in rows), default=-1)
        return WindowPlan(
            spans=df.sparkSession.createDataFrame(rows, spans.schema),
            rows=rows,
            n_snapshots=len(rows),
            n_windows=max(last, -1) + 1,
            n_triples=sum(row["n_triples"] for row in rows),
        )
    snapshots = ordered_snapshots(df)
    staged = stage(window_spans(snapshots, width, step, include_partial), "spans").frame
    totals = staged.agg(
        F.count("*").alias("snapshots"),
        F.max("last_window").alias("last"),
        F.sum("n_triples").alias("triples"),
    ).first()
    return WindowPlan(staged, None, totals["snapshots"], totals["last"] + 1, totals["triples"])


def join_plan(df: DataFrame, plan: WindowPlan, side: DataFrame, columns: list[str]) -> DataFrame:
    """Join triples to per-snapshot ``columns`` of ``side``, pruning the rest.

    ``side`` has one row per snapshot, with its ``n_triples`` and windows. The filter on
    them lets Spark prune a partitioned store by the snapshots that are left when the
    calendar has been broadcast, however many there are.
    """
    side = side.where("first_window <= last_window")
    return weighted_join(
        df,
        side.select("snapshot", F.col("n_triples").alias("weight"), *columns),
        ["snapshot"],
        plan.n_snapshots * _CALENDAR_ROW_BYTES,
        plan.n_triples,
    )


def assign_windows(
    df: DataFrame,
    width: int,
    step: int = 1,
    include_partial: bool = False,
    plan: WindowPlan | None = None,
) -> DataFrame:
    """Tag triples with ``window_id``, one output row per containing window.

    Triples in no window drop out. The small side of the join has one row per
    snapshot, however wide the windows are. A ``plan`` that was made for ``df``
    with the same arguments saves finding its snapshots again.
    """
    _check(width, step)
    plan = plan or plan_windows(df, width, step, include_partial)
    joined = join_plan(df, plan, plan.spans, ["first_window", "last_window"])
    return joined.select(
        *(F.col(name) for name in df.columns), F.explode(_window_ids()).alias("window_id")
    )
