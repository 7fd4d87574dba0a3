"""Long repeated byte strings of a corpus, found by run-length indexes of what may repeat.

A window is ``length`` bytes of one text. Every window has an anchor: the 32 bytes in it
whose hash is smallest, the first of several. Equal windows have equal anchors, so windows
meet by the hash of their anchor, and an anchor whose hash occurs once has no repeat. The
windows of an anchor are neighbours; the text they cover is the anchor's context. Contexts
that occur more than once whole are repeats at once. The distinct contexts that share an
anchor go to one task, are indexed together, and their windows' longest matches say which
of them occur elsewhere.

Texts are staged in numbered blocks, one bucket of the table a block, so what is found
comes back to them without moving a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import PrefixHash, map_batches, mix, ship
from factdrift.llm.run_index import RunIndex
from factdrift.staging import BROADCAST_BYTES, delete_at_exit, scratch_path, stage

LENGTH = 200
ANCHOR = 32
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 20
# Rows of one anchor that a task takes as they are; more are split by what surrounds it.
GROUP_ROWS = 512
INDEX_BYTES = 1 << 17
_STARTS = 1 << 17
_PLACE_BITS = 18
_EVERY_BIT = (1 << 64) - 1


@dataclass(frozen=True)
class Blocks:
    """Texts in blocks: block, row, doc_id, text (binary)."""

    frame: DataFrame


def stage_blocks(docs: DataFrame) -> Blocks:
    """Number the rows of ``docs`` (doc_id, text) and keep them by block.

    A block is at most ``BLOCK_BYTES`` of text, or one text. Numbers are written with the
    texts, so they stay whatever is computed again.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            lengths = np.diff(_offsets(batch.column(1)))
            blocks, rows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int32)
            for k, length in enumerate(lengths.tolist()):
                if row and (size + length > BLOCK_BYTES or row == BLOCK_ROWS):
                    block, size, row = block + 1, 0, 0
                blocks[k], rows[k] = block, row
                size, row = size + length, row + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), pa.array(rows), batch.column(0), batch.column(1)], ["block", "row", "doc_id", "text"]
            )

    plain = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")
    )
    numbered = map_batches(plain, run, "block long, row int, doc_id long, text binary")
    name, path = f"text_blocks_{uuid.uuid4().hex}", scratch_path(spark, "text-blocks")
    (
        numbered.write.option("path", path)
        .option("compression", "zstd")
        .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
        .saveAsTable(name)
    )
    delete_at_exit(spark, path)
    return Blocks(spark.table(name))


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a binary column start and end in its bytes."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the offsets of its values."""
    offsets = _offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes from every place on."""
    n = len(data) - ANCHOR + 1
    words = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        count = (len(data) - k) // 8
        words[k::8] = np.frombuffer(data[k : k + 8 * count].tobytes(), "<u8")
    hashes = np.zeros(n, np.uint64)
    # Odd multipliers.
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        hashes ^= words[8 * k : 8 * k + n]
        hashes *= np.uint64(factor)
        hashes ^= hashes >> np.uint64(29)
    return mix(hashes)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(values)
    rows = np.full(-(-n // width) * width, _EVERY_BIT, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    so_far = np.minimum.accumulate(rows, axis=1).ravel()
    to_come = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_come[: n - width + 1], so_far[width - 1 : n])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, context hash, text, first window, last window) of every anchor.

    Windows are places in ``data``. It is gone through in parts, however long a text is.
    """
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for start in range(0, max(len(data) - length + 1, 0), _STARTS):
        part = data[start : start + _STARTS + length - 1]
        hashes = _anchor_hashes(part)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(ranked, length - ANCHOR + 1) & low).astype(np.int64)
        # Windows that stay within their text.
        ends = offsets[np.searchsorted(offsets, start, side="right") : np.searchsorted(offsets, start + len(part))] - start
        valid = np.ones(len(at) + 1, bool)
        for end in ends.tolist():
            valid[max(end - length + 1, 0) : end] = False
        windows = np.flatnonzero(valid[:-1])
        if len(windows) == 0:
            continue
        # Windows of different texts are never neighbours: those between them are not valid.
        first = np.append(True, (np.diff(at[windows]) != 0) | (np.diff(windows) != 1))
        firsts = windows[first]
        lasts = windows[np.append(np.flatnonzero(first)[1:], len(windows)) - 1]
        text = np.searchsorted(offsets, firsts + start, side="right") - 1
        yield hashes[at[firsts]], PrefixHash(part).spans(firsts, lasts + length), text, firsts + start, lasts + start


# A place: the row in its block, the first window in the row, and how many windows follow.
_COUNT_BITS, _START_BITS = 12, 31


def find_anchors(blocks: Blocks, length: int) -> DataFrame:
    """(key, chash, block, place): anchor and context hashes, and where the windows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(2))
            block, row = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            if len(data) == 0:
                continue
            for hashes, whole, text, firsts, lasts in _anchors(data, offsets, length):
                place = (row[text] << _START_BITS | firsts - offsets[text]) << _COUNT_BITS | lasts - firsts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(block[text]), pa.array(place)],
                    ["key", "chash", "block", "place"],
                )

    texts = blocks.frame.select("block", "row", "text")
    return map_batches(texts, run, "key long, chash long, block long, place long")


def _placed(place: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and last window in the row."""
    values = place.to_numpy()
    first = values >> _COUNT_BITS & ((1 << _START_BITS) - 1)
    return values >> (_COUNT_BITS + _START_BITS), first, first + (values & ((1 << _COUNT_BITS) - 1))


def _sorted_texts(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, doc ids, all bytes and offsets of a block."""
    texts = texts.combine_chunks()
    batch = texts.to_batches()[0]
    rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
    data, offsets = _bytes(batch.column("text"))
    return rows, ids, data, offsets


_CONTEXTS = "key long, chash long, n long, windows int, bytes binary"
_PIECES = f"okey long, ochash long, skip int, {_CONTEXTS}"
_FOUND = "key long, chash long, first int, last int"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _cut_contexts(blocks: Blocks, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of ``chosen`` contexts (block, place, key, chash, n)."""

    def cut(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        if wanted.num_rows == 0:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.table([pa.array([], t) for t in types], _names(_CONTEXTS))
        rows, _, data, offsets = _sorted_texts(texts)
        wanted = wanted.combine_chunks()
        row, first, last = _placed(wanted.column("place").chunk(0))
        order = np.argsort(rows)
        starts = offsets[order[np.searchsorted(rows[order], row)]]
        raw = data.tobytes()
        begin, end = (starts + first).tolist(), (starts + last + length).tolist()
        columns = [
            *(wanted.column(c).chunk(0) for c in ("key", "chash", "n")),
            pa.array((last - first + 1).astype(np.int32)),
            pa.array([raw[a:b] for a, b in zip(begin, end, strict=True)], pa.binary()),
        ]
        return pa.table(columns, _names(_CONTEXTS))

    left = blocks.frame.select("block", "row", "doc_id", "text").groupBy("block")
    return left.cogroup(chosen.groupBy("block")).applyInArrow(cut, _CONTEXTS)


def _runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges > 0).tolist(), (np.flatnonzero(edges < 0) - 1).tolist(), strict=True))


def _index_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of distinct contexts that come sorted by key."""
    group: list[tuple] = []
    pending: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(raw) for *_, raw in pending], np.int64)
        data = np.frombuffer(b"".join(raw for *_, raw in pending), np.uint8)
        found = RunIndex(data, lengths).match_lengths() >= length
        starts = (np.cumsum(lengths + 1) - lengths - 1).tolist()
        out = [
            (key, chash, a, b)
            for (key, chash, n, windows, _), start in zip(pending, starts, strict=True)
            for a, b in ([(0, windows - 1)] if n > 1 else _runs_of(found[start : start + windows]))
        ]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(_FOUND))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if group and row[0] != group[0][0]:
                # A context alone that occurs once has no repeat.
                if len(group) > 1 or group[0][2] > 1:
                    pending += group
                    size += sum(len(x[4]) for x in group)
                group = []
                if size >= INDEX_BYTES:
                    yield flush()
                    pending, size = [], 0
            group.append(row)
    if len(group) > 1 or group and group[0][2] > 1:
        pending += group
    if pending:
        yield flush()


def _split(contexts: DataFrame, level: int, length: int) -> DataFrame:
    """Cut contexts of crowded anchors by where in its windows the anchor stands.

    Windows with the anchor at about the same place share more than the anchor: the key of
    a piece hashes all that they share. At the last level that is the window itself.
    """
    width = max(-(-(length - ANCHOR + 1) >> level), 1)
    low = np.uint64((1 << _PLACE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for okey, ochash, n, windows, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                hashes = _anchor_hashes(np.frombuffer(raw, np.uint8)[:length])
                anchor = int(np.argmin((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)))
                start = 0
                while start < windows:
                    node = (anchor - start) // width
                    stop = min(windows - 1, anchor - node * width)
                    most = min(node * width + width - 1, length - ANCHOR)
                    shared = raw[anchor - node * width : anchor - most + length]
                    key = xxhash.xxh3_64_intdigest(shared, level * 1024 + node)
                    piece = raw[start : stop + length]
                    whole = xxhash.xxh3_64_intdigest(piece, anchor - start)
                    out.append((okey, ochash, start, key, whole, n, stop - start + 1, piece))
                    start = stop + 1
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(8)]
            for k in (3, 4):
                columns[k] = np.array(columns[k], np.uint64).view(np.int64)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(_PIECES))

    return map_batches(contexts, run, _PIECES)


def match_contexts(contexts: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS, level: int = 0) -> DataFrame:
    """(key, chash, first, last): windows of distinct ``contexts`` that occur elsewhere too.

    An anchor with up to ``group_rows`` contexts is indexed in one task. Those of a more
    crowded one are cut into pieces that share more of their text, equal pieces become one
    that counts for all, and pieces are matched likewise. At the last level a piece is one
    window, of which no two distinct ones share a key.
    """
    keys = contexts.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows)
    crowded = stage(keys.select("key"), "crowded-anchors").frame
    count = crowded.count()
    small = contexts
    if count:
        # Eight bytes each; beyond the limit both sides shuffle.
        few = F.broadcast(crowded) if count * 64 <= BROADCAST_BYTES else crowded
        small = contexts.join(few, "key", "left_anti")
    dealt = small.select(*_names(_CONTEXTS)).repartition("key").sortWithinPartitions("key")
    found = map_batches(dealt, lambda batches: _index_groups(batches, length), _FOUND)
    if not count:
        return found
    many = contexts.join(few, "key", "left_semi").select(*_names(_CONTEXTS))
    pieces = stage(_split(many, level + 1, length), f"pieces-{level + 1}").frame
    distinct = pieces.groupBy("key", "chash").agg(
        F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes")
    )
    inner = match_contexts(stage(distinct, f"contexts-{level + 1}").frame, length, group_rows, level + 1)
    of_pieces = pieces.drop("n", "windows", "bytes").join(stage(inner, f"matched-{level + 1}").frame, ["key", "chash"])
    return found.unionByName(
        of_pieces.select(
            F.col("okey").alias("key"),
            F.col("ochash").alias("chash"),
            (F.col("skip") + F.col("first")).alias("first"),
            (F.col("skip") + F.col("last")).alias("last"),
        )
    )


def find_repeats(blocks: Blocks, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(block, row, start, end): bytes of windows that start anywhere else too."""
    anchors = find_anchors(blocks, length)
    # Counts and extremes combine before they move, however often an anchor occurs. They are
    # written first: a join of two plain shuffles is one that Spark can split at a hot key.
    repeated = stage(
        anchors.groupBy("key")
        .agg(F.count("*").alias("times"), F.min("chash").alias("least"), F.max("chash").alias("most"))
        .where("times > 1")
        .select("key", (F.col("least") != F.col("most")).alias("mixed")),
        "anchors-met-again",
    ).frame
    placed = stage(anchors.join(repeated, "key"), "repeated-anchors").frame
    chosen = (
        placed.where("mixed")
        .groupBy("key", "chash")
        .agg(F.count("*").alias("n"), F.min(F.struct("block", "place")).alias("one"))
        .select("key", "chash", "n", "one.block", "one.place")
    )
    contexts = stage(_cut_contexts(blocks, chosen, length), "contexts").frame
    matched = stage(match_contexts(contexts, length, group_rows), "matched-contexts").frame
    row = F.shiftright("place", _COUNT_BITS + _START_BITS).cast("int").alias("row")
    start = F.shiftright("place", _COUNT_BITS).bitwiseAND(F.lit((1 << _START_BITS) - 1))
    count = F.col("place").bitwiseAND(F.lit((1 << _COUNT_BITS) - 1))
    whole = placed.where("not mixed").select("block", row, start.alias("start"), (start + count + length).alias("end"))
    some = placed.where("mixed").join(matched, ["key", "chash"]).select(
        "block", row, (start + F.col("first")).alias("start"), (start + F.col("last") + length).alias("end")
    )
    return whole.unionByName(some)


_KEPT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, removed spans (bytes, end exclusive) and kept bytes of ``docs`` (doc_id, text).

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere
    else, in this text or in another row's. Strings are judged on the texts as given: all
    copies go, none is left. Texts shorter than ``length`` stay whole; a null text counts
    as empty. Repeated rows are copies of each other, a null doc_id stays null, an empty
    table gives no rows, further columns are ignored. ``kept`` may cut a character.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"Strings need {2 * ANCHOR} bytes or more.")
    blocks = stage_blocks(docs)
    marks = find_repeats(blocks, length, group_rows)

    def remove(texts: pa.Table, marked: pa.Table) -> pa.Table:
        rows, ids, data, offsets = _sorted_texts(texts)
        depth = np.zeros(len(data) + 1, np.int32)
        if marked.num_rows:
            order = np.argsort(rows)
            at = offsets[order[np.searchsorted(rows[order], marked.column("row").to_numpy())]]
            np.add.at(depth, at + marked.column("start").to_numpy(), 1)
            np.add.at(depth, at + marked.column("end").to_numpy(), -1)
        gone = np.cumsum(depth[:-1]) > 0
        # Spans end with their text.
        inside = np.append(gone, False)
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        texts_at = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[texts_at] = gone[texts_at]
        ends = inside[:-1] & ~inside[1:]
        lasts = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends[lasts] = gone[lasts]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        bounds = np.searchsorted(first, offsets)
        own = np.repeat(offsets[:-1], np.diff(bounds))
        spans = pa.StructArray.from_arrays([pa.array(first - own), pa.array(last - own)], ["start", "end"])
        kept = np.append(0, np.cumsum(~gone))[offsets]
        left = data[~gone].tobytes()
        return pa.table(
            [
                ids,
                pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans),
                pa.array([left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
            ],
            ["doc_id", "n_bytes", "removed", "kept"],
        )

    ship(docs.sparkSession)
    left = blocks.frame.select("block", "row", "doc_id", "text").groupBy("block")
    return left.cogroup(marks.groupBy("block")).applyInArrow(remove, _KEPT)
