"""Tokens of each document in flat token files without an index, by a scan for separators.

A flat file holds ids of a fixed width, document after document, each followed by the
end-of-document id. It is read as blocks that are cut anywhere: (stream, block, data).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factdrift.llm.bpe import encoder
from factdrift.llm.common import map_batches, strings
from factdrift.staging import BROADCAST_BYTES, delete_at_exit, scratch_path, stage

BLOCK_BYTES = 1 << 20
# Files up to this size are read as one value, larger ones by ranges of it.
WHOLE_BYTES = 1 << 28
# Blocks that are scanned together.
SCAN_GROUP = 4096
# What a block's place takes in a broadcast table, at most.
_PLACE_BYTES = 64
_KINDS = {2: "<u2", 4: "<u4"}


def write_token_stream(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of ``docs`` (doc_id, text) as flat streams, one for each partition.

    The table has the streams' blocks (stream, block, data) and, apart from them, the
    doc_ids in the order written (stream, first, doc_ids). Spark has no writer of raw
    bytes, so the blocks are rows of a Parquet table in the shared folder. Special tokens
    spelled out in a text are ordinary text, so the separator only ends documents.
    A null text counts as empty.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-stream")
    rows = map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        partial(_write_stream, tokenizer=tokenizer, end_id=end_id, kind=_KINDS[width], block_bytes=_whole_ids(block_bytes)),
        "stream long, block long, data binary, first long, doc_ids array<long>",
    )
    rows.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _write_stream(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, kind: str, block_bytes: int):
    encode = encoder(tokenizer, specials=False).encode
    stream, block, rest, written = TaskContext.get().partitionId(), 0, b"", 0
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for first in range(0, len(texts), 256):
            ids, counts = encode(texts[first : first + 256])
            if len(ids) and ids.max() >= 1 << 8 * np.dtype(kind).itemsize:
                raise ValueError("The ids need more bytes.")
            rest += np.insert(ids, np.cumsum(counts), end_id).astype(kind).tobytes()
            cuts = range(0, len(rest) - block_bytes + 1, block_bytes)
            yield _stream_rows([(stream, block + i, rest[at : at + block_bytes], None, None) for i, at in enumerate(cuts)])
            block, rest = block + len(cuts), rest[len(cuts) * block_bytes :]
            yield _stream_rows([(stream, None, None, written, docs[first : first + 256])])
            written += len(counts)
    if rest:
        yield _stream_rows([(stream, block, rest, None, None)])


def _stream_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["stream", "block", "data", "first", "doc_ids"]
    )


def flat_file_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Raw flat files as blocks (stream, block, data), cut between ids.

    A file of up to ``whole_bytes`` is read by Spark as one value, from any store it knows.
    A larger one is read by ranges of that size, each in a task of its own, so no size is
    too large; Arrow opens those, from local or mounted folders, HDFS, S3, GCS and Azure.
    ``block_bytes`` is rounded down to whole ids. An empty file has no blocks.
    """
    size = _whole_ids(block_bytes)
    span = -(-whole_bytes // size) * size
    files = spark.read.format("binaryFile").load(path)
    whole = files.where(F.col("length") <= whole_bytes).select("path", F.lit(0).cast("long").alias("start"), "content")
    ranges = (
        files.where(F.col("length") > whole_bytes)
        .select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("start"))
        .repartition("path", "start")
    )

    def cut_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                data = content.as_buffer()
                for at in range(0, data.size, size):
                    yield _block_row(name, at // size, data[at : at + size].to_pybytes())

    def cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(name) as file:
                    for at in range(start, min(start + span, file.size()), size):
                        yield _block_row(name, at // size, file.read_at(min(size, file.size() - at), at))

    schema = "stream string, block long, data binary"
    return map_batches(whole, cut_values, schema).unionByName(map_batches(ranges, cut_ranges, schema))


def _whole_ids(block_bytes: int) -> int:
    """The largest size up to ``block_bytes`` that cuts no id of any width."""
    widest = max(_KINDS)
    return max(block_bytes - block_bytes % widest, widest)


def _open(name: str) -> pa.NativeFile:
    """The file of a path as Spark writes it."""
    if name.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + name.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(name)
    return system.open_input_file(inner)


def _block_row(stream: str, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([stream]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["stream", "block", "data"]
    )


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(stream, doc_index, n_tokens, ended) of ``blocks`` (stream, block, data).

    Each block is read and searched once, with array operations, for ``end_id``; what was
    found is written to the shared folder. A document that began in earlier blocks gets its
    open tokens from a prefix scan over the blocks' summaries, in two levels: within groups
    of ``SCAN_GROUP`` blocks, then over the groups' sums, so a long stream is spread over
    tasks. The end id itself is not counted. Tokens after a stream's last end id are one
    more document that has not ended. Blocks hold whole ids; an empty or null block adds
    nothing, a null stream is a stream, a null block number is before all others. No
    blocks, no rows. Of repeated (stream, block) rows each counts, in the order of a hash
    of their bytes; further columns are ignored.
    """
    found = stage(
        map_batches(
            blocks.select("stream", F.col("block").cast("long"), "data"),
            partial(_find_ends, end_id=end_id, kind=_KINDS[width]),
            f"stream {dict(blocks.dtypes)['stream']}, block long, hash long, ends array<long>, tail long",
        )
        .withColumn("n", F.size("ends"))
        .withColumn("row", F.monotonically_increasing_id()),
        "token-ends",
    ).frame
    # Only sums move; what was found in a block stays where it is, or moves once.
    small = found.select("stream", "block", "hash", "n", "tail", "row").withColumn("part", F.floor(F.col("block") / SCAN_GROUP))
    inner = stage(_scan(small, ["stream", "part"], ["block", "hash", "row"]), "token-sums").frame
    sums = inner.groupBy("stream", "part").agg(
        F.sum("n").alias("n"),
        F.max_by(_open_after(), F.struct("block", "hash", "row")).alias("tail"),
    )
    outer = _scan(sums, ["stream"], ["part"])
    before = outer.select(
        F.col("stream").alias("s"), F.col("part").alias("p"), F.col("first_doc").alias("docs_before"), F.col("carry").alias("open_before")
    )
    placed = inner.join(before, F.col("stream").eqNullSafe(F.col("s")) & F.col("part").eqNullSafe(F.col("p"))).select(
        "row",
        (F.col("first_doc") + F.col("docs_before")).alias("first_doc"),
        (F.col("carry") + F.when(F.col("first_doc") == 0, F.col("open_before")).otherwise(0)).alias("carry"),
    )
    if inner.count() * _PLACE_BYTES <= BROADCAST_BYTES:
        placed = F.broadcast(placed)
    docs = (
        found.where("n > 0")
        .join(placed, "row")
        .select("stream", "first_doc", "carry", F.posexplode("ends").alias("k", "n_tokens"))
        .select(
            "stream",
            (F.col("first_doc") + F.col("k")).alias("doc_index"),
            (F.col("n_tokens") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
            F.lit(True).alias("ended"),
        )
    )
    last = outer.groupBy("stream").agg(F.sum("n").alias("doc_index"), F.max_by(_open_after(), F.struct("part")).alias("n_tokens"))
    return docs.unionByName(last.where("n_tokens > 0").withColumn("ended", F.lit(False)))


def _scan(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the documents that ended before each (first_doc) and the tokens open there (carry)."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # All tails before a row, less those before the last end: a tail after ends starts anew.
    open_before = F.coalesce(F.sum("tail").over(before), F.lit(0))
    return (
        rows.withColumn("first_doc", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("open", open_before)
        .withColumn("reset", F.coalesce(F.last(F.when(F.col("n") > 0, F.col("open")), ignorenulls=True).over(before), F.lit(0)))
        .withColumn("carry", F.col("open") - F.col("reset"))
        .drop("open", "reset")
    )


def _open_after() -> Column:
    """Tokens open behind a scanned row."""
    return F.col("tail") + F.when(F.col("n") > 0, 0).otherwise(F.col("carry"))


def _find_ends(batches: Iterator[pa.RecordBatch], end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, tails, hashes = [], [], []
        for data in batch.column(2):
            raw = (data.as_buffer() if data.is_valid else None) or b""
            ids = np.frombuffer(raw, kind)
            at = np.flatnonzero(ids == end_id)
            ends.append(np.diff(at, prepend=-1) - 1)
            tails.append(len(ids) - (int(at[-1]) + 1 if len(at) else 0))
            hashes.append(xxhash.xxh64_intdigest(raw) >> 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(hashes, pa.int64()),
                pa.array(ends, pa.list_(pa.int64())),
                pa.array(tails, pa.int64()),
            ],
            ["stream", "block", "hash", "ends", "tail"],
        )


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """doc_id, n_tokens of ``docs`` (doc_id, text), through flat streams and the scan.

    A null or empty text has no tokens; each of repeated rows counts, a null doc_id stays
    null, an empty table gives no rows, further columns are ignored.
    """
    written = write_token_stream(docs, tokenizer, end_id, width)
    counted = count_tokens(written.where("data is not null"), end_id, width)
    order = written.where("data is null").select("stream", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
    named = order.select("stream", (F.col("first") + F.col("k")).alias("doc_index"), "doc_id")
    return named.join(counted, ["stream", "doc_index"]).select("doc_id", "n_tokens")
