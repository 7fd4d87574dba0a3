"""Document fingerprints: one-permutation MinHash, optimal densification, packed low bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factdrift.llm.common import PrefixHash, blocks, code_points, map_batches, mix, strings
from factdrift.staging import stage

SHINGLE = 5
BINS = 256  # a power of two
LOW_BITS = 8  # what is stored of a bin: one byte
BLOCK = 1 << 18
SEED = 11

_turns = np.random.default_rng(SEED).permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)


def shingle_hashes(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the text each is of; A-Z in lower case.

    Words are what white space (blank, tab to carriage return) parts. Fewer words than a
    shingle has are one shingle; no words, none.
    """
    chars = code_points("".join(f"{text} " for text in texts))
    chars = np.where((chars >= 65) & (chars <= 90), chars + np.uint32(32), chars)
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    word = (chars != 32) & ((chars < 9) | (chars > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    words = PrefixHash(chars).spans(starts, ends)
    last = np.searchsorted(starts, ends_of_text)
    counts = np.diff(last, prepend=0)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(last, counts) - np.arange(len(words))  # words from here on
    place = np.arange(len(words)) - np.repeat(last - counts, counts)
    total = np.zeros(len(words), np.uint64)
    for k in range(shingle):
        step = np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        here = np.flatnonzero(left > k)
        total[here] += words[here + k] * step
    begins = (left >= shingle) | (place == 0)
    return mix(total[begins]), owner[begins]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of bytes for each text; ``is_blank`` tells texts without words apart."""
    hashes, owner = shingle_hashes(texts)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (hashes >> shift).astype(np.int64)
    least = np.full(len(texts) * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, owner * BINS + bins, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(len(texts), BINS)
    full = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    low = (least & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    for k in np.flatnonzero(~full.all(1) & full.any(1)):
        # An empty bin tries the others in its own fixed random order until one is full.
        there, empty = np.flatnonzero(full[k]), np.flatnonzero(~full[k])
        low[k, empty] = low[k, there[_turns[np.ix_(empty, there)].argmin(1)]]
    return low


def fingerprints(texts: list[str]) -> list[bytes]:
    """A fingerprint for each text, from all of it; empty bytes for a text without words."""
    out: list[bytes] = []
    for first, last in blocks(map(len, texts), BLOCK):
        some = texts[first:last]
        rows = sketches(some)
        out += [row.tobytes() if text.strip(" \t\n\v\f\r") else b"" for row, text in zip(rows, some, strict=True)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of the shingles, corrected for low bits that agree by chance."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    chance = 2.0**-LOW_BITS
    return min(max((same - chance) / (1 - chance), 0.0), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the head of ``following``."""
    size = len(text) // 4
    return text[: len(text) - size] + following[:size]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (bytes) of each whole text of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(plain, run, "doc_id long, fingerprint binary")


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGE = "part long, first_text string, first_print binary, last_doc long, last_text string, last_print binary"
_NAMES = [c.split()[0] for c in f"{_ROW}, {_EDGE}".split(", ")]
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.binary()]


def _compare(docs: list, texts: list[str], prints: list[bytes], following: list[str], next_prints: list[bytes]) -> list[tuple]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    changed_prints = fingerprints(changed)
    return [
        (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, after))
        for doc, text, new, own, new_print, after in zip(docs, texts, changed, prints, changed_prints, next_prints, strict=True)
    ]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], _NAMES)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the next; the partition's ends go to a row of their own."""
    first, last = None, None
    for batch in batches:
        ids, all_texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for a, b in blocks(map(len, all_texts), BLOCK):
            docs, texts = ids[a:b], all_texts[a:b]
            prints = fingerprints(texts)
            first = first or (texts[0], prints[0])
            if last is not None:
                docs, texts, prints = [last[0], *docs], [last[1], *texts], [last[2], *prints]
            rows = _compare(docs[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            last = docs[-1], texts[-1], prints[-1]
            yield _rows([row + (None,) * 6 for row in rows])
    if last is not None:
        yield _rows([(None,) * 7 + (TaskContext.get().partitionId(), *first, *last)])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness to it and the next.

    Rows are dealt by ranges of doc_id, once, and each task streams through its own; only
    the first and last row of each task meet others. The next of the last row is the first,
    so a lone row is its own. A null text counts as empty, a null doc_id comes first, rows
    that share a doc_id are ordered by a hash of the text. An empty table gives no rows,
    further columns are ignored.
    """
    order = ["doc_id", "h"]
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = plain.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(map_batches(dealt.select("doc_id", "text"), _follow, f"{_ROW}, {_EDGE}"), "fingerprints").frame
    inner = found.where("part is null").select(*_NAMES[:7])
    edges = found.where("part is not null").select(*_NAMES[7:])
    # One short row for each partition.
    parts = edges.select("part")
    following = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.partitionBy()).alias("start"))
    after = edges.select(F.col("part").alias("after"), F.col("first_text").alias("next_text"), F.col("first_print").alias("next_print"))
    ends = (
        edges.select("part", "last_doc", "last_text", "last_print")
        .join(following.select("part", F.coalesce("after", "start").alias("after")), "part")
        .join(after, "after")
        .select("last_doc", "last_text", "last_print", "next_text", "next_print")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _compare(*(c.to_pylist() for c in batch.columns))
            yield _rows([row + (None,) * 6 for row in rows]).select(_NAMES[:7])

    return inner.unionByName(map_batches(ends, run, _ROW))
