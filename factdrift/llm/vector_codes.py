"""Short codes for vectors, from codebooks in exact integer arithmetic.

Vectors become integers and are cut into parts; a part's code is its nearest entry in the
part's codebook. Distances come from matrix products that are exact: integers are broken
into limbs so narrow that every float64 product stays below 2^53, and the products are
put together again in int64, or in unbounded integers where int64 might not hold them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import map_batches
from factdrift.staging import BROADCAST_BYTES, stage, weighted_join

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BATCH_ROWS = 4096
_EXACT = 53
_SUM_BITS = 40
_LONG = (1 << 63) - 1

Books = list[np.ndarray]


def limb_width(dimension: int) -> int:
    """Bits of a limb: products of two, summed over the dimension, stay below 2^53."""
    return (_EXACT - max(dimension - 1, 1).bit_length()) // 2


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """Float64 limbs, lowest first; the last one has the sign."""
    largest = int(max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))))
    count = max(1, -(-largest.bit_length() // width))
    mask = (1 << width) - 1
    out = [((values >> (width * k)) & mask).astype(np.float64) for k in range(count - 1)]
    return [*out, (values >> (width * (count - 1))).astype(np.float64)]


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of integers (int64 or object), exactly; object where int64 may not do."""
    dimension = left.shape[1]
    width = limb_width(dimension)
    bound = dimension * _largest(left) * _largest(right)
    total = np.zeros((len(left), len(right)), np.int64 if bound <= _LONG else object)
    for i, a in enumerate(limbs(left, width)):
        for j, b in enumerate(limbs(right, width)):
            product = (a @ b.T).astype(np.int64)
            if total.dtype == object:
                product = product.astype(object)
            total += product << (width * (i + j))
    return total


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def quantized(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles, exactly: int64, or object for huge values."""
    if np.abs(values).max(initial=0.0) < 2.0**40:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    far = _largest(part) + _largest(book)
    if part.shape[1] * far * far > _LONG:
        part, book = part.astype(object), book.astype(object)
    distances = (part * part).sum(1)[:, None] - exact_products(part, book) * 2 + (book * book).sum(1)[None, :]
    first = np.argmin(distances, axis=1)
    return first, distances[np.arange(len(part)), first]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return quantized(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0))


def _cut(values: np.ndarray, parts: int) -> list[np.ndarray]:
    width = values.shape[1] // parts
    return [values[:, k * width : (k + 1) * width] for k in range(parts)]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False)))


def _sums(kept: DataFrame, books: Books) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Rows and componentwise sums of the parts assigned to each entry.

    A task sums up all its rows; sums leave it in pieces of 40 bits, so that no sum of
    theirs can overflow. What reaches the driver is as large as the codebooks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(book), np.int64) for book in books]
        sums = [np.zeros(book.shape, object) for book in books]
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                values = _vectors(batch.column(0)[start : start + BATCH_ROWS])
                for k, part in enumerate(_cut(values, len(books))):
                    chosen, _ = nearest(part, books[k])
                    hits = np.zeros((len(books[k]), len(part)), np.int64)
                    hits[chosen, np.arange(len(part))] = 1
                    counts[k] += hits.sum(1)
                    sums[k] += exact_products(hits, np.ascontiguousarray(part.T)).astype(object)
        rows = []
        for k, total in enumerate(sums):
            for entry in np.flatnonzero(counts[k]).tolist():
                rows.append((k, entry, -1, 0, int(counts[k][entry])))
                for position, value in enumerate(total[entry].tolist()):
                    limb = 0
                    while not -(1 << _SUM_BITS) < value < 1 << _SUM_BITS:
                        rows.append((k, entry, position, limb, value & ((1 << _SUM_BITS) - 1)))
                        value, limb = value >> _SUM_BITS, limb + 1
                    rows.append((k, entry, position, limb, value))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["part", "entry", "position", "limb", "value"]
            )

    pieces = map_batches(kept.select("embedding"), run, "part long, entry long, position long, limb long, value long")
    totals = pieces.groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in totals.collect():
        count, values = found.get((r.part, r.entry), (0, [0] * books[r.part].shape[1]))
        if r.position < 0:
            count += int(r.value)
        else:
            values[r.position] += int(r.value) << (_SUM_BITS * r.limb)
        found[r.part, r.entry] = count, values
    return found


def _narrowed(rows: list[list[int]], width: int) -> np.ndarray:
    """Codebook rows as int64 where they fit."""
    small = all(abs(x) < 1 << 62 for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), width)


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of ``parts`` from ``rounds`` passes over all rows.

    They start as the rows with the smallest vec_ids; of equal ids the smaller vector comes
    first, and null ids come last. A round moves every entry to the floor of its parts'
    mean; entries without parts stay. There are fewer entries than ``entries`` where there
    are fewer rows.
    """
    firsts = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
    start = quantized(np.array([r.embedding for r in firsts.collect()], np.float64))
    books = [np.array(part) for part in _cut(start, parts)]
    for _ in range(rounds):
        for (part, entry), (count, values) in _sums(kept, books).items():
            moved = books[part].tolist()
            moved[entry] = [value // count for value in values]
            books[part] = _narrowed(moved, books[part].shape[1])
    return books


def books_digest(books: Books) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for row in book.tolist() for x in row).encode()).hexdigest()


def encode(kept: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, codes (binary, a byte for each part) and error of ``kept``.

    ``error`` is null where it does not fit a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(start, BATCH_ROWS)
                codes, errors = [], np.zeros(some.num_rows, object)
                for k, part in enumerate(_cut(_vectors(some.column(2)), len(books))):
                    chosen, distances = nearest(part, books[k])
                    codes.append(chosen.astype(np.uint8))
                    errors += distances.astype(object)
                raw = np.stack(codes, 1).tobytes()
                width = len(books)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
                        pa.array([x if x <= _LONG else None for x in map(int, errors)], pa.int64()),
                    ],
                    ["vec_id", "label", "codes", "error"],
                )

    label = dict(kept.dtypes)["label"]
    plain = kept.select(F.col("vec_id").cast("long"), "label", "embedding")
    return map_batches(plain, run, f"vec_id long, label {label}, codes binary, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """vec_id, label, codes, error, label_error of ``vectors`` (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds a null or a value that is not finite drop out. All
    other rows stay, repeated ones and those without vec_id or label too; rows without a
    label share one label_error. A sum that does not fit a long is null. An empty table
    gives no rows and no codebooks; further columns are ignored. Vectors of several
    dimensions, or of one that ``parts`` does not divide, are an error.
    """
    kept = usable(vectors.select("vec_id", "label", "embedding"))
    size = F.size("embedding")
    shape = kept.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.count("*").alias("rows")).first()
    if not shape["rows"]:
        empty = kept.select(F.col("vec_id").cast("long"), "label", F.lit(None).cast("binary").alias("codes"))
        return empty.withColumns({c: F.lit(None).cast("long") for c in ("error", "label_error")}), []
    if shape["least"] != shape["most"] or shape["least"] % parts:
        raise ValueError(f"Vectors need one dimension that {parts} divides; there are {shape['least']} to {shape['most']}.")
    books = train_codebooks(kept, parts, entries, rounds)
    coded = stage(encode(kept, books), "vector-codes").frame
    keys: dict[str, Callable] = {
        "unlabelled": F.col("label").isNull(),
        "named": F.coalesce(F.col("label").cast("string"), F.lit("")),
    }
    keyed = coded.withColumns(keys)
    fits = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = stage(
        keyed.groupBy(*keys).agg(fits.try_cast("long").alias("label_error"), F.count("*").alias("weight")), "label-errors"
    ).frame
    # A label counts with its text and some numbers beside it.
    width = sums.agg(F.sum(F.octet_length("named") + 64)).first()[0]
    joined = weighted_join(keyed, sums, list(keys), min(width, BROADCAST_BYTES + 1), shape["rows"])
    return joined.select("vec_id", "label", "codes", "error", "label_error"), books
