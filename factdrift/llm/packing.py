"""Bounded-space online packing of documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.bpe import encoder
from factdrift.llm.common import map_batches, strings
from factdrift.staging import stage

LENGTH = 2048
OPEN_WINDOWS = 16
PARTITIONS_A_MERGE = 16
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
# Sequences closed by a partition have its number above these bits; merged ones bit 62 too.
_LOCAL_BITS = 36
_MERGED = 1 << 62


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places in sequences of ``length`` tokens.

    A document is its ids and then ``end_id``. Every partition keeps ``open_windows``
    windows. Full lengths of a document are sequences of their own; what is left goes to
    the window it fits best. If it fits none, a window is opened; if all are open, the
    fullest is filled up with the head of the piece and emitted, so it needs no padding.
    Windows left open at the end of a partition carry their ids to a merge of
    ``PARTITIONS_A_MERGE`` partitions, which fills them up from the emptiest ones. The
    last tokens of a merge become sequences of powers of two, so none is padded.

    A null text counts as empty (one piece, the end id); a null doc_id is kept; repeated
    rows are packed each; further columns are ignored; an empty table gives no pieces.
    Memory: the open windows, and one text's ids.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("The sequence length has to be a power of two.")
    placed = stage(
        map_batches(
            docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
            partial(_pack_partition, tokenizer=tokenizer, end_id=end_id, length=length, open_windows=open_windows),
            _PIECE + ", merge long, ids binary",
        ),
        "placed",
    ).frame
    closed = placed.where("merge is null").drop("merge", "ids")
    merged = placed.where("merge is not null").groupBy("merge").applyInArrow(lambda left: _merge(left, length), _PIECE)
    return closed.unionByName(merged)


class _Sequences:
    """Rows of finished pieces; gives out sequence numbers."""

    def __init__(self, base: int):
        self.next, self.rows = base, []

    def add(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class _Windows:
    """A fixed number of open windows, ordered by the room that is left."""

    def __init__(self, length: int, most: int, out: _Sequences):
        self.length, self.most, self.out = length, most, out
        self.rooms: list[tuple[int, int]] = []  # room, number of the window
        self.pieces: dict[int, list[tuple]] = {}
        self.opened = 0

    def place(self, piece: tuple) -> None:
        doc, start, total, ids = piece
        at = bisect_left(self.rooms, (len(ids), -1))
        if at == len(self.rooms) and len(self.rooms) == self.most:
            room, number = self.rooms.pop(0)  # the fullest
            self.out.add([*self.pieces.pop(number), (doc, start, total, ids[:room])])
            return self.place((doc, start + room, total, ids[room:]))
        if at == len(self.rooms):
            room, number = self.length, self.opened
            self.opened += 1
            self.pieces[number] = []
        else:
            room, number = self.rooms.pop(at)
        self.pieces[number].append(piece)
        if room == len(ids):
            self.out.add(self.pieces.pop(number))
        else:
            insort(self.rooms, (room - len(ids), number))


def _pack_partition(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, length: int, open_windows: int):
    encode = encoder(tokenizer).encode
    part = TaskContext.get().partitionId()
    out = _Sequences(part << _LOCAL_BITS)
    windows = _Windows(length, open_windows, out)
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for first in range(0, len(texts), 256):
            ids, counts = encode(texts[first : first + 256])
            end = np.cumsum(counts)
            for doc, a, b in zip(docs[first : first + 256], end - counts, end, strict=True):
                whole = np.append(ids[a:b], np.uint32(end_id))
                full = len(whole) // length * length
                for start in range(0, full, length):
                    out.add([(doc, start, len(whole), whole[start : start + length])])
                if full < len(whole):
                    windows.place((doc, full, len(whole), whole[full:]))
            yield _rows(out.take())
    rows = []
    for room, number in windows.rooms:
        for doc, start, total, ids in windows.pieces[number]:
            rows.append((doc, start, len(ids), None, total, number, room, part // PARTITIONS_A_MERGE, ids.astype("<u4").tobytes()))
    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    columns = list(zip(*(row + (None,) * (9 - len(row)) for row in rows), strict=True)) or [()] * 9
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "merge", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _merge(left: pa.Table, length: int) -> pa.Table:
    """Fill the fullest windows from the emptiest; ``offset`` holds a window's room here.

    Rows stay Arrow values: numbers with nulls among them keep all their bits.
    """
    columns = [left.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "offset", "sequence_id")]
    rows = sorted(zip(*columns, strict=True), key=lambda r: (r[4], r[0] is None, r[0] or 0, r[1], r[5]))
    out = _Sequences(_MERGED | left.column("merge")[0].as_py() << _LOCAL_BITS)
    pieces = [(doc, start, total, np.frombuffer(ids, "<u4")) for doc, start, total, ids, _, _ in rows]
    rest = sum(len(x[3]) for x in pieces)
    fill: list[tuple] = []
    target = room = length if rest >= length else 1 << max(rest.bit_length() - 1, 0)
    for doc, start, total, ids in pieces:
        while len(ids):
            head = ids[:room]
            fill.append((doc, start, total, head))
            start, ids, room = start + len(head), ids[len(head) :], room - len(head)
            if room == 0:
                out.add(fill)
                fill, rest = [], rest - target
                target = room = length if rest >= length else 1 << max(rest.bit_length() - 1, 0)
    found = _rows(out.take())
    return pa.Table.from_batches([found]).select(found.schema.names[:7])
