"""Embedding near-duplicates by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import blocks, components, gather, map_batches, mix
from factdrift.staging import BROADCAST_BYTES, stage, weighted_join

COSINE = 0.98
RECALL = 0.9995
PROJECTIONS = 32
# In standard deviations of the difference that two just linked vectors have.
HALF_WINDOW, CELL = 1.5, 8.0
CELL_ROWS = 128
BLOCK_ROWS = 512
CHUNK_PAIRS = 1 << 18
SEED = 7
_CELL = ["label", "size", "part", "cell"]


@dataclass(frozen=True)
class Plan:
    """Widths of windows and cells, the count a pair has to reach, how vectors are dealt."""

    half_window: float
    least: int
    cell: float
    axes: int  # projections that name a cell
    parts: int  # independent ways to deal the vectors to cells


def calibrated(rows: int, cosine: float = COSINE, recall: float = RECALL, projections: int = PROJECTIONS) -> Plan:
    """Counts and cells with which a linked pair is found with probability ``recall`` each.

    Along a Gaussian direction the difference of two unit vectors with this cosine is
    normal with variance 2 - 2 cos; closer pairs collide more often. ``rows`` is the size of
    the largest label: a cell is named by as many projections as leave about ``CELL_ROWS``
    of unrelated vectors in it, and vectors are dealt to cells in as many ways as the recall
    needs, a number that grows with a small power of ``rows``.
    """
    spread = math.sqrt(max(2 - 2 * cosine, 1e-12))
    p = math.erf(HALF_WINDOW / math.sqrt(2))
    chance, least = 1.0, 0  # of a count of ``least`` or more
    while least < projections:
        lower = chance - math.comb(projections, least) * p**least * (1 - p) ** (projections - least)
        if lower < recall:
            break
        chance, least = lower, least + 1
    near, far = _same_cell(CELL * spread, spread), _same_cell(CELL * spread, math.sqrt(2))
    axes = max(0, math.ceil(math.log(max(rows, 1) / CELL_ROWS) / -math.log(far)))
    parts = math.ceil(math.log(1 - recall) / math.log1p(-(near**axes))) if axes else 1
    return Plan(HALF_WINDOW * spread, least, CELL * spread, axes, parts)


def _same_cell(width: float, deviation: float) -> float:
    """How likely a normal difference of this deviation stays in a cell at a random place."""
    z = width / deviation
    return math.erf(z / math.sqrt(2)) - 2 * (1 - math.exp(-z * z / 2)) / (z * math.sqrt(2 * math.pi))


@lru_cache(maxsize=1024)
def directions(dimension: int, projections: int, use: int = 0) -> np.ndarray:
    return np.random.default_rng([SEED, dimension, use]).standard_normal((dimension, projections))


def cells(units: np.ndarray, plan: Plan, parts: int) -> np.ndarray:
    """The hashed cell of each vector in the first ``parts`` ways to deal them."""
    found = np.zeros((len(units), parts), np.uint64)
    for part in range(parts):
        shift = np.random.default_rng([SEED, part]).random(plan.axes)
        at = np.floor(units @ directions(units.shape[1], plan.axes, part + 1) / plan.cell + shift).astype(np.int64)
        for column in at.T:
            found[:, part] = mix(found[:, part] + column.view(np.uint64) + np.uint64(1))
    return found


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and digest, which is null where a vector links with nothing."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    digest = F.sha2(F.col("embedding").cast("string"), 256)
    return vectors.select("vec_id", "label", "embedding", F.when(F.coalesce(usable, F.lit(False)), digest).alias("digest"))


def classes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of ``keyed`` rows: label, digest, embedding, node (smallest vec_id), copies."""
    return rows.where("digest is not null").groupBy("label", "digest", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def _units(raw: list[bytes], dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dimension)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares too large nor too small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _deal(batches: Iterator[pa.RecordBatch], plan: Plan, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(1)], np.int64)
        for size in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
            raw = [np.asarray(x.values, np.float64) for x in rows.column(1)]
            named = cells(_units([x.tobytes() for x in raw], int(size)), plan, plan.parts).view(np.int64)
            data = pa.array([x.astype(kind).tobytes() for x in raw], pa.binary())
            for part in range(plan.parts):
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(raw), size)),
                        pa.array(np.full(len(raw), part)),
                        pa.array(np.ascontiguousarray(named[:, part])),
                        rows.column(2),
                        rows.column(3),
                        data,
                    ],
                    [*_CELL, "node", "copies", "vector"],
                )


class _Side:
    """One side of some cells: unit vectors, hashed cells, ids and copies, row by row."""

    def __init__(self, column: pa.ListArray, first: int, last: int, dimension: int, kind: str, plan: Plan, parts: int):
        rows = column.slice(first, last - first)
        self.sizes = np.asarray(rows.value_lengths(), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.group = np.repeat(np.arange(last - first), self.sizes)
        values = rows.flatten()
        raw = np.frombuffer(b"".join(values.field("vector").to_pylist()), kind)
        self.units = _units([raw.astype("<f8").tobytes()], dimension)
        self.cells = cells(self.units, plan, parts)
        self.ids, self.copies = (values.field(k).to_numpy(zero_copy_only=False) for k in ("node", "copies"))


def _collisions(a: _Side, b: _Side, axes: np.ndarray, half_window: float) -> np.ndarray:
    """How many projections have b's vector in the window around a's, for all pairs of a cell.

    The cells of a chunk lie side by side on each axis, further apart than a window, so one
    sort serves them all. A cell's pairs are consecutive, a's rows first.
    """
    sizes = a.sizes * b.sizes
    base = np.cumsum(sizes) - sizes
    row = base[a.group] + (np.arange(len(a.ids)) - a.starts[a.group]) * b.sizes[a.group]
    column = np.arange(len(b.ids)) - b.starts[b.group]
    counts = np.zeros(int(sizes.sum()), np.int64)
    for x, y in zip((a.units @ axes).T, (b.units @ axes).T, strict=True):
        apart = 4 * (max(np.abs(x).max(), np.abs(y).max()) + half_window)
        x, y = x + apart * a.group, y + apart * b.group
        order = np.argsort(y)
        first = np.searchsorted(y[order], x - half_window, "left")
        found = np.searchsorted(y[order], x + half_window, "right") - first
        ranks = gather(first, found)
        counts += np.bincount(np.repeat(row, found) + column[order[ranks]], minlength=len(counts))
    return counts


def _match(batches: Iterator[pa.RecordBatch], cosine: float, plan: Plan, projections: int, kind: str) -> Iterator[pa.RecordBatch]:
    """For cells, or pairs of blocks: linked copies of each node, links that span what is linked.

    A pair that shares several cells counts in the first of its parts only.
    """
    for batch in batches:
        part, size, ours, theirs = (batch.column(i) for i in range(4))
        part, size, own = np.asarray(part), np.asarray(size), np.asarray(theirs.is_null())
        sizes = np.asarray(ours.value_lengths()), np.asarray(theirs.value_lengths().fill_null(0))
        pairs = np.where(own, sizes[0].astype(np.int64) ** 2, sizes[0].astype(np.int64) * sizes[1])
        alike = np.flatnonzero((np.diff(size) != 0) | (np.diff(own) != 0)) + 1
        for low, high in zip([0, *alike], [*alike, len(own)], strict=True):
            for first, last in blocks(pairs[low:high].tolist(), CHUNK_PAIRS):
                first, last = low + first, low + last
                a, b = (
                    _Side(x, first, last, int(size[first]), kind, plan, int(part[first:last].max())) if x is not None else None
                    for x in (ours, None if own[first] else theirs)
                )
                yield _links(a, b, part[first:last], cosine, plan, projections)


def _links(a: _Side, b: _Side | None, part: np.ndarray, cosine: float, plan: Plan, projections: int) -> pa.RecordBatch:
    other = a if b is None else b
    counts = _collisions(a, other, directions(a.units.shape[1], projections), plan.half_window)
    hits = np.flatnonzero(counts >= plan.least)
    sizes = a.sizes * other.sizes
    ends = np.cumsum(sizes)
    group = np.searchsorted(ends, hits, "right")
    i, j = np.divmod(hits - (ends - sizes)[group], other.sizes[group])
    i, j = a.starts[group] + i, other.starts[group] + j
    kept = np.zeros(len(hits), bool)
    for k in range(0, len(hits), 1 << 15):
        at = slice(k, k + (1 << 15))
        met = (a.cells[i[at]] == other.cells[j[at]]) & (np.arange(a.cells.shape[1]) < part[group[at], None])
        kept[at] = ~met.any(1) & (np.einsum("ij,ij->i", a.units[i[at]], other.units[j[at]]) >= cosine)
    if b is None:
        kept &= i != j
    i, j = i[kept], j[kept]
    linked = np.zeros(len(a.ids), np.int64)
    np.add.at(linked, i, other.copies[j])
    ids, at = a.ids, j
    if b is not None:
        more = np.zeros(len(b.ids), np.int64)
        np.add.at(more, j, a.copies[i])
        ids, linked, at = np.concatenate([a.ids, b.ids]), np.concatenate([linked, more]), j + len(a.ids)
    roots = _roots(len(ids), i, at)
    some, moved = np.flatnonzero(linked), np.flatnonzero(roots != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[some], ids[moved]]), pa.int64()),
            pa.array(np.concatenate([linked[some], np.zeros(len(moved), np.int64)]), pa.int64()),
            pa.array([None] * len(some) + ids[roots[moved]].tolist(), pa.int64()),
        ],
        ["node", "linked", "other"],
    )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first one that the pairs (a, b) connect it with."""
    roots = np.arange(n)
    while True:
        before = roots.copy()
        np.minimum.at(roots, a, roots[b])
        np.minimum.at(roots, b, roots[a])
        roots = roots[roots]
        if np.array_equal(roots, before):
            return roots


def find_matches(distinct: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, linked, other: copies linked to a node, and links (other not null).

    Vectors of a label meet in cells named by several projections, dealt anew in several
    parts, so that the pairs compared grow little faster than the vectors (see
    ``calibrated``). Within a cell every projection is sorted, collisions in the windows
    around each query are counted, and pairs that reach the calibrated count are verified
    by their cosine. A cell of more than ``block_rows`` is cut into blocks by the hash of
    the node, and each pair of its blocks is a row of its own; no pair is dropped.
    """
    largest = distinct.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    plan = calibrated(largest, cosine, projections=projections)
    kind = "<f4" if dict(distinct.dtypes)["embedding"] == "array<float>" else "<f8"
    dealt = map_batches(
        distinct.select("label", F.col("embedding").cast("array<double>"), F.col("node").cast("long"), F.col("copies").cast("long")),
        lambda batches: _deal(batches, plan, kind),
        f"label {dict(distinct.dtypes)['label']}, size long, part long, cell long, node long, copies long, vector binary",
    )
    placed = stage(dealt, "placed-vectors")
    counted = stage(placed.frame.groupBy(*_CELL).agg(F.count("*").alias("weight")).where("weight > 1"), "cells")
    total = counted.frame.agg(F.count("*").alias("cells"), F.sum("weight").alias("rows")).first()
    sizes = counted.frame.withColumn("blocks", F.ceil(F.col("weight") / block_rows).cast("long"))
    width = 64 * total["cells"] + (0 if total["cells"] == 0 else counted.frame.agg(F.sum(F.octet_length(F.col("label").cast("string")))).first()[0])
    in_blocks = weighted_join(placed.frame, sizes, _CELL, width, total["rows"] or 0).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt_blocks = in_blocks.groupBy(*_CELL, "blocks", "block").agg(F.collect_list(F.struct("node", "copies", "vector")).alias("ours"))
    own = dealt_blocks.select("part", "size", "ours", F.lit(None).cast(dict(dealt_blocks.dtypes)["ours"]).alias("theirs"))
    several = dealt_blocks.where("blocks > 1")
    asking = several.where("block + 1 < blocks").withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    asked = several.select(*_CELL, "block", F.col("ours").alias("theirs"))
    pairs = asking.join(asked, [*_CELL, "block"]).select("part", "size", "ours", "theirs")
    matches = map_batches(own.unionByName(pairs), lambda batches: _match(batches, cosine, plan, projections, kind), "node long, linked long, other long")
    found = stage(matches, "matches")
    placed.drop()
    counted.drop()
    return found.frame


def group(vectors: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one node that counts its copies, so copies are never
    paired. Links hold only between equal, non-null labels and equal dimensions; a vector
    that is null, zero or holds a null or a value that is not finite links with nothing,
    not even its copy; nor does a row without vec_id, whose component is null. Repeated rows stay.
    An empty table gives no rows, further columns are ignored.
    """
    rows = keyed(vectors)
    distinct = stage(classes(rows), "distinct-vectors").frame
    matches = find_matches(distinct, cosine, projections)
    degrees = matches.where("other is null").groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(matches.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = distinct.drop("embedding").join(degrees, "node", "left").join(roots, "node", "left")
    named = stage(
        nodes.select(
            "label",
            "digest",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
            F.col("copies").alias("weight"),
        ),
        "named-vectors",
    ).frame
    size = named.agg(F.coalesce(F.sum(F.octet_length(F.col("label").cast("string")) + 128), F.lit(0)).alias("bytes"), F.sum("weight").alias("rows")).first()
    usable = rows.where("digest is not null").select("vec_id", "label", "digest")
    found = weighted_join(usable, named, ["label", "digest"], min(size["bytes"], BROADCAST_BYTES + 1), size["rows"] or 0)
    own = F.col("vec_id").cast("long")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return (
        found.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"))
        .unionByName(alone)
        .withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(False)))
    )
