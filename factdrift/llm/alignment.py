"""Two tokenizers side by side: which of their tokens cover the same bytes.

Texts are shuffled whole and merged when equal, so each distinct text is tokenised and
aligned once and counts as often as it occurs. Counts of token pairs follow from the
distinct texts and their multiplicity; measures go back to the rows by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.bpe import BLOCK, encoder
from factdrift.llm.bpe_chunks import id_bytes
from factdrift.llm.common import blocks, gather, map_batches
from factdrift.llm.pieces import piece_encoder
from factdrift.staging import BROADCAST_BYTES, stage, weighted_join

# Up to this many distinct pairs tasks look counts up in arrays of 17 bytes a pair.
LOOKUP_PAIRS = 3_000_000
# Pairs that a worker handles at a time.
_PENDING_PAIRS = 1 << 19
# Characters that are aligned at a time.
_BLOCK = BLOCK >> 1
_B_BITS = 24

_tables: dict[tuple[str, str], Tables] = {}


class ByteTable:
    """The bytes of every id."""

    def __init__(self, raw: list[bytes]):
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._flat = np.frombuffer(b"".join(raw), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self._flat[gather(self._starts[ids], self.lengths[ids])]


class Tables:
    """Both tokenizers of this Python worker; they outlive the task."""

    def __init__(self, first: str, second: str):
        self.a, self.b = encoder(first, specials=False), piece_encoder(second)
        raw = id_bytes(self.a)
        self.a_bytes, self.b_bytes = ByteTable(raw), ByteTable(self.b.raw)
        self.n_a = len(raw)
        # Ids of A with "," and "|" behind them, then those of B with "," and ";".
        ends = ((self.n_a, b","), (self.n_a, b"|"), (len(self.b.raw), b","), (len(self.b.raw), b";"))
        self.decimal = [str(i).encode() + end for size, end in ends for i in range(size)]


def _loaded(first: str, second: str) -> Tables:
    if (first, second) not in _tables:
        _tables[first, second] = Tables(first, second)
    return _tables[first, second]


def _agree(ids: np.ndarray, counts: np.ndarray, table: ByteTable, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts whose tokens' bytes, joined, are the ``expected`` ones."""
    ends = np.append(0, np.cumsum(table.lengths[ids]))
    good = np.diff(ends[np.append(0, np.cumsum(counts))]) == sizes
    mine = table.joined(ids[np.repeat(good, counts)])
    theirs = expected[np.repeat(good, sizes)]
    same = np.append(0, np.cumsum(mine == theirs))
    at = np.append(0, np.cumsum(sizes[good]))
    out = good.copy()
    out[good] = np.diff(same[at]) == sizes[good]
    return out


class Aligned:
    """Tokens of some texts in both vocabularies, their groups and links.

    ``kept`` marks the texts that have tokens; all arrays are over those alone.
    """

    def __init__(self, raw: list[bytes], tables: Tables):
        texts = [x.decode("utf-8", "replace") for x in raw]
        expected = [b" " + x if x else b"" for x in raw]
        sizes = np.array([len(x) for x in expected], np.int64)
        whole = np.frombuffer(b"".join(expected), np.uint8)
        a, n_a = tables.a.encode([" " + x if x else "" for x in texts])
        b, n_b = tables.b.encode(texts)
        self.kept = (sizes > 0) & _agree(a, n_a, tables.a_bytes, whole, sizes) & _agree(b, n_b, tables.b_bytes, whole, sizes)
        self.a, self.b = a[np.repeat(self.kept, n_a)].astype(np.int64), b[np.repeat(self.kept, n_b)].astype(np.int64)
        self.n_a, self.n_b = n_a[self.kept], n_b[self.kept]
        ends = np.cumsum(sizes[self.kept])
        size = int(ends[-1]) if len(ends) else 0
        # Where tokens end, by place; a text's end is an end of both.
        a_ends, b_ends = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        a_ends[np.cumsum(tables.a_bytes.lengths[self.a])] = True
        b_ends[np.cumsum(tables.b_bytes.lengths[self.b])] = True
        both = a_ends & b_ends
        cuts = np.flatnonzero(a_ends | b_ends)
        # Between neighbouring ends of any kind one token of each overlaps: a link.
        self.link_a = self.a[(np.cumsum(a_ends) - a_ends)[cuts]]
        self.link_b = self.b[(np.cumsum(b_ends) - b_ends)[cuts]]
        self.n_links = np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0)
        shared = np.flatnonzero(both)
        self.n_groups = np.diff(np.searchsorted(shared, ends, side="right"), prepend=0)
        # Tokens of each group.
        self.group_a = np.diff(np.cumsum(a_ends)[shared], prepend=0)
        self.group_b = np.diff(np.cumsum(b_ends)[shared], prepend=0)

    def digests(self, tables: Tables) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each kept text."""
        total = self.group_a + self.group_b
        first = np.cumsum(total) - total
        codes = np.empty(int(total.sum()), np.int64)
        for ids, sizes, at, offset, size in (
            (self.a, self.group_a, first, 0, tables.n_a),
            (self.b, self.group_b, first + self.group_a, 2 * tables.n_a, len(tables.b.raw)),
        ):
            last = np.zeros(len(ids), np.int64)
            last[np.cumsum(sizes) - 1] = size
            codes[gather(at, sizes)] = ids + offset + last
        ends = np.cumsum(self.n_a + self.n_b)
        out = []
        for start, end in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist(), strict=True):
            joined = b"".join(map(tables.decimal.__getitem__, codes[start:end].tolist()))
            out.append(hashlib.sha256(joined[:-1]).hexdigest())
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each kept text, how often each occurs, and how many a text has."""
        text = np.repeat(np.arange(len(self.n_links)), self.n_links)
        order = np.lexsort((self.link_a << _B_BITS | self.link_b, text))
        text, pair = text[order], (self.link_a << _B_BITS | self.link_b)[order]
        new = np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        return pair[starts], np.diff(np.append(starts, len(pair))), np.bincount(text[starts], minlength=len(self.n_links))


_ALIGNED = (
    "digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs_a array<int>, pairs_b array<int>, times array<int>"
)


def align_distinct(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row for each distinct text of ``docs``, aligned: its digest, how many rows have it, counts and pairs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    distinct = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _loaded(first, second)
        for batch in batches:
            texts, n = batch.column(0), batch.column(1)
            for start, end in blocks(pc.binary_length(texts).to_pylist(), _BLOCK):
                yield _aligned_rows(texts[start:end].to_pylist(), n[start:end], tables)

    return map_batches(distinct.select(F.col("text").cast("binary"), "n"), run, _ALIGNED)


def _aligned_rows(raw: list[bytes], n: pa.Array, tables: Tables) -> pa.RecordBatch:
    found = Aligned(raw, tables)
    pair, times, sizes = found.pairs()
    every = np.zeros(len(raw), np.int64)
    at = np.flatnonzero(found.kept)

    def spread(values: np.ndarray) -> pa.Array:
        out = every.copy()
        out[at] = values
        return pa.array(out)

    digests = [""] * len(raw)
    for k, digest in zip(at.tolist(), found.digests(tables), strict=True):
        digests[k] = digest
    out = every.copy()
    out[at] = sizes
    offsets = pa.array(np.append(0, np.cumsum(out)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair >> _B_BITS, pair & ((1 << _B_BITS) - 1), times)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
            n,
            *(spread(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
            pa.array(digests),
            *lists,
        ],
        ["digest", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs_a", "pairs_b", "times"],
    )


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose lists in ``column`` hold ``_PENDING_PAIRS`` pairs at most, or one row."""
    for batch in batches:
        for first, last in blocks(pc.list_value_length(batch.column(column)).to_pylist(), _PENDING_PAIRS):
            yield batch.slice(first, last - first)


def _lists(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, their times and how many each row has, of the list columns from ``first`` on."""
    a, b, times = (batch.column(first + k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    sizes = np.diff(batch.column(first).offsets.to_numpy().astype(np.int64))
    return a << _B_BITS | b, times, sizes


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weights = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[starts], np.add.reduceat(weights[order], starts)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): links of each id pair over all rows, and whether none of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        links: list[np.ndarray] = []

        def merge() -> None:
            pairs[:], links[:] = ([x] for x in _merged(pairs, links))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(links[0])], ["pair", "links"])

        for batch in _sliced(batches, 1):
            pair, times, sizes = _lists(batch, 1)
            if len(pair) == 0:
                continue
            pairs.append(pair)
            links.append(times * np.repeat(batch.column(0).to_numpy(), sizes))
            if sum(map(len, pairs)) > _PENDING_PAIRS:
                merge()
                if len(pairs[0]) > _PENDING_PAIRS // 2:
                    yield rows()
                    pairs.clear()
                    links.clear()
        if pairs:
            merge()
            yield rows()

    lists = aligned.select("n", "pairs_a", "pairs_b", "times")
    counted = map_batches(lists, run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counts = stage(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))), "pair-counts").frame
    # One row for each id of the second vocabulary.
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest, n_best, count_sum) from arrays that every task has."""
    table = pairs.orderBy("pair").toArrow()
    held = aligned.sparkSession.sparkContext.broadcast(
        tuple(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "links", "best"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = held.value
        for batch in _sliced(batches, 1):
            pair, times, sizes = _lists(batch, 1)
            at = np.searchsorted(known, pair)
            ends = np.cumsum(sizes)
            sums = [np.append(0, np.cumsum(x)) for x in ((times * best[at], times * links[at]) if len(pair) else (pair, pair))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x[ends] - x[ends - sizes]) for x in sums)], ["digest", "n_best", "count_sum"]
            )

    return map_batches(aligned.select("digest", "pairs_a", "pairs_b", "times"), run, "digest binary, n_best long, count_sum long")


def _joined(aligned: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """The same by a join on pairs, for vocabularies with more pairs than a task may hold."""
    code = F.shiftleft(F.col("p.pairs_a").cast("long"), _B_BITS).bitwiseOR(F.col("p.pairs_b").cast("long"))
    rows = aligned.select("digest", F.explode(F.arrays_zip("pairs_a", "pairs_b", "times")).alias("p")).select(
        "digest", code.alias("pair"), F.col("p.times").alias("times")
    )
    weighed = pairs.withColumn("weight", F.col("links"))
    found = weighted_join(rows, weighed, ["pair"], BROADCAST_BYTES + 1, total)
    sums = found.groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    )
    kept = aligned.select("digest").join(sums, "digest", "left")
    return kept.select("digest", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, first: str, second: str, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """doc_id and the alignment's measures for each row of ``docs`` (doc_id, text).

    ``first`` is a byte-level BPE of the tokenizers library, ``second`` a SentencePiece
    model. A text that is null or empty, or that either tokenizer does not spell back byte
    for byte, has no tokens: zeros and an empty digest. Repeated rows stay and count each,
    a null doc_id stays null, an empty table gives no rows, further columns are ignored.
    Of two pairs with equal counts both are the best of their B id.
    """
    aligned = stage(align_distinct(docs, first, second), "aligned-texts").frame
    pairs = stage(count_pairs(aligned), "pairs").frame
    size = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")).first()
    sums = _looked_up(aligned, pairs) if size["pairs"] <= lookup_pairs else _joined(aligned, pairs, size["links"])
    measures = aligned.drop("pairs_a", "pairs_b", "times").join(sums, "digest").withColumnRenamed("n", "weight")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"),
    )
    # Texts that many rows share are joined without a shuffle, the others by their digest.
    total = aligned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = weighted_join(rows, stage(measures, "text-measures").frame, ["digest"], BROADCAST_BYTES + 1, total)
    return named.select("doc_id", *MEASURES)
