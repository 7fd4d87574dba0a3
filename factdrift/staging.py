"""Staged tables and size-checked joins.

Frames that several jobs read are written once, as Parquet, to the shared folder
the cluster names in ``spark.checkpoint.dir``. That cuts their lineage, survives
lost executors and lets every later job read only the columns it needs.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only below this size; see bounded_join.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
# Bounds of what weighted_join broadcasts when it splits: count and length of keys.
HEAVY_KEYS = 10_000
HEAVY_KEY_BYTES = 4096

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    Only a local session without ``spark.checkpoint.dir`` gets a folder of its
    own; a cluster has to name one all executors can reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    if context.applicationId not in _local_roots:
        root = tempfile.mkdtemp(prefix="factdrift-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[context.applicationId] = root
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Staged:
    """A frame read back from the table it was written to."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete what was written to ``path`` when the application ends."""
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)


def stage(df: DataFrame, label: str) -> Staged:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table can be dropped before; it is deleted at the latest when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def bounded_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    small_bytes: int,
    spread_by: list[str],
) -> DataFrame:
    """Inner equi-join with a ``small`` side of measured size.

    Within ``BROADCAST_BYTES`` the small side is broadcast. Beyond it both sides
    shuffle, and the big side is salted by ``spread_by`` so that one hot key
    spreads over many tasks; the small side is repeated once per salt.
    """
    if small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, "inner")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], "inner").drop("_salt")


def weighted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    small_bytes: int,
    total_weight: int,
) -> DataFrame:
    """Inner equi-join with a ``small`` side that knows how often its keys occur.

    ``small`` holds every key of ``on`` once and its number of rows on the big
    side, or an upper bound of it, in ``weight``. When it is too large to broadcast whole, the
    keys above ``1 / HEAVY_KEYS`` of ``total_weight``, of which there are at most
    ``HEAVY_KEYS``, are broadcast and never shuffled; no other key can be hot.
    """
    plain = small.drop("weight")
    if small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(plain), on, "inner")
    width = sum((F.octet_length(F.col(key).cast("string")) for key in on), F.lit(0))
    heavy = (F.col("weight") * HEAVY_KEYS > total_weight) & (width <= HEAVY_KEY_BYTES)
    hot = small.where(heavy).drop("weight")
    rest = small.where(~heavy).drop("weight")
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return big.join(F.broadcast(hot), on, "inner").unionByName(cold.join(rest, on, "inner"))
