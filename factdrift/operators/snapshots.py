"""Snapshots: one graph state, valid at one time."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime
from itertools import pairwise

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.ntriples import parse_lines
from ..staging import BROADCAST_BYTES, bounded_join


def tag_snapshot(df: DataFrame, snapshot: str, snapshot_ts: datetime) -> DataFrame:
    """Add the snapshot's id and the time it is valid at."""
    return df.withColumns(
        {"snapshot": F.lit(snapshot), "snapshot_ts": F.lit(snapshot_ts).cast("timestamp")}
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name, duplicates kept.

    Halving keeps the plan shallow while it is built; the optimizer flattens it.
    """
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return union_all(frames[:middle]).unionByName(union_all(frames[middle:]))


def ingest_snapshot(
    spark: SparkSession,
    path: str,
    snapshot: str,
    snapshot_ts: datetime,
    mode: str = "permissive",
) -> DataFrame:
    """Read one snapshot's N-Triples and tag them."""
    return ingest_snapshots(spark, {snapshot: (path, snapshot_ts)}, mode)


def _matched_roots(spark: SparkSession, path: str) -> list[str]:
    """The files and folders that a path or glob stands for, as Spark names them."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return [_NO_AUTHORITY.sub(r"\1/", status.getPath().toUri().toString()) for status in found or ()]


# ``file:///a`` and ``file:/a`` are the same place.
_NO_AUTHORITY = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*:)///")
# Assumed size of an entry in the broadcast map of files or paths.
_ROOT_BYTES = 1024


def _tag_of(file: str, tags: Mapping[str, list]) -> list:
    """What the path that ``file`` is, or is in, is tagged with; nothing if there is none."""
    path = _NO_AUTHORITY.sub(r"\1/", file)
    while path not in tags and "/" in path:
        path = path.rpartition("/")[0]
    return tags.get(path, [])


def ingest_snapshots(
    spark: SparkSession,
    snapshots: Mapping[str, tuple[str, datetime]],
    mode: str = "permissive",
    observation: Observation | None = None,
) -> DataFrame:
    """Read ``{id: (path, timestamp)}`` into one frame of temporal triples.

    All paths are one scan, however many snapshots there are; a line's snapshot follows
    from its file, looked up in a map with one entry for each file while that can be
    broadcast, and for each path beyond. Only paths within each other, whose files belong
    to several snapshots, are scans of their own.
    Small files share tasks, so a task can hold several snapshots.
    """
    if not snapshots:
        raise ValueError("No snapshots to ingest.")
    roots = [
        (root, snapshot, snapshot_ts)
        for snapshot, (path, snapshot_ts) in snapshots.items()
        for root in _matched_roots(spark, str(path))
    ]
    names = sorted({root + "/" for root, _, _ in roots})
    nested = len(names) < len(roots) or any(b.startswith(a) for a, b in pairwise(names))
    missing = len({snapshot for _, snapshot, _ in roots}) < len(snapshots)
    if nested or missing or len(roots) == 1:
        # A missing path is Spark's to complain about.
        lines = [
            tag_snapshot(spark.read.text(str(path)), snapshot, snapshot_ts)
            for snapshot, (path, snapshot_ts) in snapshots.items()
        ]
        return parse_lines(union_all(lines), mode, observation)
    read = spark.read.text([str(path) for path, _ in snapshots.values()])
    files = read._jdf.inputFiles()
    if len(files) * _ROOT_BYTES <= BROADCAST_BYTES:
        tags = {root: tag for root, *tag in roots}
        found = [(file, *_tag_of(file, tags)) for file in files]
        if all(tag for _, *tag in found):
            of_file = spark.createDataFrame(found, "_file string, snapshot string, snapshot_ts timestamp")
            # Never null, so that no filter finds the file's name once more.
            lines = read.select("value", F.coalesce(F.input_file_name(), F.lit("")).alias("_file"))
            return parse_lines(lines.join(F.broadcast(of_file), "_file").drop("_file"), mode, observation)
    file = F.regexp_replace(F.col("_metadata.file_path"), _NO_AUTHORITY.pattern, "$1/")
    depths = sorted({root.count("/") + 1 for root, _, _ in roots})
    above = F.array_distinct(F.array(*(F.substring_index(file, "/", depth) for depth in depths)))
    lines = read.select("value", (above[0] if len(depths) == 1 else F.explode(above)).alias("_root"))
    of_root = spark.createDataFrame(roots, "_root string, snapshot string, snapshot_ts timestamp")
    tagged = bounded_join(lines, of_root, ["_root"], len(roots) * _ROOT_BYTES, ["value"])
    return parse_lines(tagged.drop("_root"), mode, observation)
