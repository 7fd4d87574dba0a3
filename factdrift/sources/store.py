"""The snapshot-partitioned Parquet store of temporal triples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ntriples import TRIPLE_SCHEMA

TEMPORAL_SCHEMA = T.StructType(
    [
        *TRIPLE_SCHEMA.fields,
        T.StructField("snapshot_ts", T.TimestampType(), True),
        T.StructField("snapshot", T.StringType(), True),
    ]
)

# What a task sorts and writes at most, and what a row has besides its texts, 16 a column aside.
_TASK_BYTES = 256 * 1024 * 1024
_ROW_BYTES = 32
# Snapshots whose sizes the driver looks at.
_DRIVER_ROWS = 1 << 18


def write_store(
    df: DataFrame, directory: str, mode: str = "overwrite", rebalance: bool = False
) -> None:
    """Write temporal triples, one directory per snapshot.

    Triples read from snapshot files arrive with one snapshot per task, so the
    default write needs no shuffle. ``rebalance`` is for frames whose tasks mix
    snapshots: it gathers each snapshot in few files, and splits a snapshot that
    is too large for a task. ``df`` is read twice for it.

    ``overwrite`` replaces the whole store whatever the session's settings, ``append``
    adds; see ``replace_snapshots`` for writing one snapshot again.
    """
    _partitioned(df, rebalance).option("partitionOverwriteMode", "static").mode(mode).parquet(str(directory))


def replace_snapshots(df: DataFrame, directory: str, rebalance: bool = False) -> None:
    """Write the snapshots of ``df`` in place of what the store has of them.

    Other snapshots stay as they are, and doing it again changes nothing, so a write that
    failed can be repeated. A snapshot without triples in ``df`` is not touched. ``df`` must
    not read the snapshots that it replaces.
    """
    _partitioned(df, rebalance).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(str(directory))


def _partitioned(df: DataFrame, rebalance: bool) -> DataFrameWriter:
    if rebalance:
        df = _dealt(df)
    return df.write.partitionBy("snapshot")


def _dealt(df: DataFrame) -> DataFrame:
    """Deal rows so that a task has one snapshot, a slice of a large one, or several small ones.

    A task sorts what it writes by snapshot, so it gets ``_TASK_BYTES`` at most, by a count
    of ``df`` beforehand. Equal rows stay together. Beyond ``_DRIVER_ROWS`` snapshots the
    count does not go to the driver and adaptive execution has to see to it.
    """
    texts = [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]
    length = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in texts), F.lit(_ROW_BYTES + 16 * len(df.columns)))
    counts = df.groupBy("snapshot").agg(F.sum(length).alias("bytes")).limit(_DRIVER_ROWS + 1).collect()
    if not counts or len(counts) > _DRIVER_ROWS:
        return df.hint("rebalance", "snapshot")
    places, task, filled = [], 0, 0
    for snapshot, size in sorted(counts, key=lambda r: (r["snapshot"] is not None, r["snapshot"])):
        slices = -(-size // _TASK_BYTES)
        if filled and filled + size > _TASK_BYTES:
            task, filled = task + 1, 0
        places.append((snapshot, task, slices))
        task, filled = task + slices - 1, filled + size
    of_snapshot = df.sparkSession.createDataFrame(places, "_snapshot string, _first int, _slices int")
    own = F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_slices")).cast("int")
    placed = df.join(F.broadcast(of_snapshot), F.col("snapshot").eqNullSafe(F.col("_snapshot")))
    return placed.withColumn("_task", own).repartitionById(task + 1, F.col("_task")).select(*df.columns)


def read_store(
    spark: SparkSession, directory: str, snapshots: Iterable[str] | None = None
) -> DataFrame:
    """Read the store, or only the directories of the given snapshots.

    The schema is declared: inferring it would turn snapshot ids such as
    ``2023`` or ``01`` into numbers.
    """
    triples = spark.read.schema(TEMPORAL_SCHEMA).parquet(str(directory))
    if snapshots is not None:
        triples = triples.where(F.col("snapshot").isin(list(snapshots)))
    return triples
