"""What the operators share: shipping the package, text batches, interned spans, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factdrift.staging import stage, weighted_join

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/factdrift", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def strings(column: pa.Array) -> list[str]:
    """The column's texts; a null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def blocks(lengths: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose lengths add up to ``limit`` at most, or one item."""
    first, total, last = 0, 0, 0
    for i, length in enumerate(lengths):
        if i > first and total + length > limit:
            yield first, i
            first, total = i, 0
        total += length
        last = i + 1
    if last > first:
        yield first, last


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << int(n).bit_length()
        steps = np.full(size, _MULTIPLIER, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = _INVERSE
        _inverses = np.cumprod(steps)
    return _powers, _inverses


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a bijection)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


class PrefixHash:
    """64-bit polynomial hashes of any spans of an array, from one pass over it."""

    def __init__(self, values: np.ndarray):
        powers, self._inverses = _power_tables(len(values))
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverses[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Interner:
    """Numbers distinct spans of code points, by hash and then by every code point.

    Memory is bounded: beyond ``capacity`` spans or ``max_chars`` code points the table
    starts afresh, which costs time but never changes a result.
    """

    def __init__(self, capacity: int = 1 << 20, max_chars: int = 1 << 24):
        self.capacity, self.max_chars = capacity, max_chars
        self.generation = 0
        self._mask = np.uint64(4 * capacity - 1)
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(int(self._mask) + 1, np.uint64)
        self._values = np.full(int(self._mask) + 1, -1, np.int32)
        self._chars = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(self.capacity + 1, np.int64)
        self.count = 0
        self.generation += 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes & self._mask).astype(np.int64)
        found = self._values[slots]
        todo = np.flatnonzero((self._keys[slots] != hashes) & (found >= 0))
        found[self._keys[slots] != hashes] = -1
        while len(todo):
            slots[todo] = (slots[todo] + 1) & int(self._mask)
            there, values = self._keys[slots[todo]], self._values[slots[todo]]
            hit = (there == hashes[todo]) & (values >= 0)
            found[todo[hit]] = values[hit]
            todo = todo[~hit & (values >= 0)]
        return found

    def _insert(self, hashes: np.ndarray) -> None:
        numbers = np.arange(self.count, self.count + len(hashes), dtype=np.int32)
        slots = (hashes & self._mask).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            at = slots[todo]
            free = self._values[at] < 0
            _, first = np.unique(at, return_index=True)
            chosen = np.zeros(len(todo), bool)
            chosen[first] = True
            chosen &= free
            put = todo[chosen]
            self._keys[slots[put]] = hashes[put]
            self._values[slots[put]] = numbers[put]
            todo = todo[~chosen]
            slots[todo] = np.where(self._values[slots[todo]] < 0, slots[todo], (slots[todo] + 1) & int(self._mask))

    def number(self, chars: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, add: Callable) -> np.ndarray | None:
        """The numbers of the spans. ``add(starts, ends)`` is told of new ones, in order.

        None when the table was cleared on the way (call again) or two spans share a hash
        (never call again: encode the block in another way).
        """
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            size = int((ends[first] - starts[first]).sum())
            used = int(self._starts[self.count])
            if self.count and (self.count + len(new) > self.capacity or used + size > self.max_chars):
                self._clear()
                return None
            if len(new) > self.capacity:
                raise ValueError("A block has more distinct spans than the table holds.")
            if used + size > len(self._chars):
                self._chars = np.concatenate([self._chars, np.zeros(max(len(self._chars), size), np.uint32)])
            lengths = ends[first] - starts[first]
            self._chars[used : used + size] = chars[gather(starts[first], lengths)]
            self._starts[self.count + 1 : self.count + 1 + len(new)] = used + np.cumsum(lengths)
            self._insert(new)
            self.count += len(new)
            add(starts[first], ends[first])
            found[missing] = self._find(hashes[missing])
        return found

    def agree(self, numbers: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether every span is, code point by code point, the one that got its number."""
        lengths = ends - starts
        known = self._starts[numbers]
        if not np.array_equal(self._starts[numbers + 1] - known, lengths):
            return False
        return np.array_equal(self._chars[gather(known, lengths)], chars[gather(starts, lengths)])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ``lengths[i]`` items from ``starts[i]`` on, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``links`` (a, b): node, root, the smallest node it reaches.

    Stars are rewired in turns, large then small, until nothing changes; every turn is a
    grouped minimum and a join and is written to the shared folder, so the plan stays short
    and a lost executor costs one turn. The turns grow with the logarithm of the longest
    path. No node's links meet in one task: minima are combined before they move, and in
    the joins the minima of hubs are broadcast, of which there are few, so a hub's links
    stay where they are.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    current = stage(edges, label)
    before = _summary(current.frame)
    while True:
        large = stage(_large_star(current.frame, before[0]), label)
        current.drop()
        current = stage(_small_star(large.frame, large.frame.count()), label)
        large.drop()
        summary = _summary(current.frame)
        if summary == before:
            break
        before = summary
    stars = current.frame
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _summary(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum that tells them apart from others."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


# What a number and its key take in a broadcast table, at most.
_MINIMUM_BYTES = 64


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).withColumn("m", F.least("u", "m"))
    joined = weighted_join(both.where("v > u"), least, ["u"], 2 * n_edges * _MINIMUM_BYTES, 2 * n_edges)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
    joined = weighted_join(edges, least, ["u"], n_edges * _MINIMUM_BYTES, n_edges)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
