"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. If two fingerprints differ in three bits
at most, one half differs in one bit at most. So each half is indexed with each of its bits
deleted in turn: fingerprints that may be linked share such a signature, an equality join
finds them, and their distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import components, map_batches, strings
from factdrift.staging import stage, weighted_join

SHINGLE, DISTANCE, SEED = 3, 3, 42
HALF = 32
SPLIT_ABOVE = 4096
HOT_KEYS = 10_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(counts * 2 > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, shingle) for text in strings(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(plain, run, "doc_id long, fp long")


def signatures(distinct: DataFrame) -> DataFrame:
    """(signature, fp): 64 for each fingerprint."""
    half = F.when(F.col("k") < HALF, F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))).otherwise(
        F.shiftrightunsigned("fp", HALF)
    )
    deleted = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, k % 32)")))
    return distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("k")).select(
        (deleted + F.expr("shiftleft(CAST(k AS BIGINT), 32)")).alias("signature"), "fp"
    )


def links_within(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what distances up to ``distance`` join, one less than members each.

    From a member on, all that it reaches leave the rest, so a tight group of any size
    costs a few passes; no pairs are listed.
    """
    links, rest = [], values
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = np.bitwise_count(rest ^ one) <= distance
            for other in rest[near]:
                links.append((one, other))
                front.append(other)
            rest = rest[~near]
    return links


def links_of_run(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links among the distinct fingerprints of one signature.

    A long run is cut once more by the same rule: they agree in one half but for a bit, so
    quarters of the other half are indexed; a cut run has 18 bits to differ in at most.
    """
    if len(values) <= SPLIT_ABOVE:
        return links_within(values, distance)
    links = []
    low = (values & np.uint64((1 << HALF) - 1)).astype(np.uint64)
    high = values >> np.uint64(HALF)
    other = low if np.bitwise_count(np.bitwise_or.reduce(high ^ high[0])) <= 1 else high
    for quarter in (other & np.uint64(0xFFFF), other >> np.uint64(16)):
        for bit in range(16):
            keys = quarter & ~(np.uint64(1) << np.uint64(bit))
            order = np.argsort(keys, kind="stable")
            for part in np.split(values[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part) > 1:
                    links += links_within(part, distance)
    return links


def find_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): fingerprints of ``distinct`` (fp), joined as the verified links join them."""
    if distance > 3:
        raise ValueError("Two halves find up to three differing bits.")
    dealt = signatures(distinct).repartition("signature").sortWithinPartitions("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            ends = np.flatnonzero(np.diff(keys)) + 1
            if len(ends):  # the last run may go on
                yield _links_of_runs(values[: ends[-1]], ends[:-1], distance)
                keys, values = keys[ends[-1] :], values[ends[-1] :]
        yield _links_of_runs(values, np.zeros(0, np.int64), distance)

    return map_batches(dealt, run, "a long, b long").distinct()


def _links_of_runs(values: np.ndarray, cuts: np.ndarray, distance: int) -> pa.RecordBatch:
    starts = np.append(0, cuts)
    sizes = np.diff(np.append(starts, len(values)))
    two = starts[sizes == 2]
    near = two[np.bitwise_count(values[two] ^ values[np.minimum(two + 1, max(len(values) - 1, 0))]) <= distance] if len(two) else two
    links = [(values[near], values[near + 1])] if len(near) else []
    for k in np.flatnonzero(sizes > 2):
        found = links_of_run(values[starts[k] : starts[k] + sizes[k]], distance)
        if found:
            links.append(tuple(np.array(x, np.uint64) for x in zip(*found, strict=True)))
    sides = [np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in links)]).view(np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in sides], ["a", "b"])


def group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of ``docs`` (doc_id, text).

    Documents of one fingerprint are one node, so copies are never paired. component_id is
    the smallest doc_id that links reach. A null text counts as empty, an empty one has the
    fingerprint zero, linked like any other; a null doc_id stays and names no component
    unless it has no other. Repeated rows stay, an empty table gives none, further columns
    are ignored.
    """
    found = stage(fingerprints(docs, shingle), "fingerprints").frame
    counted = found.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    nodes = stage(counted, "distinct-fingerprints").frame
    linked = components(find_links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = stage(linked.join(nodes, "fp"), "linked-fingerprints").frame
    # A giant component is one root: its smallest doc_id is broadcast, its members stay.
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("weight"))
    members = named.count()
    of_linked = weighted_join(named, smallest, ["root"], 64 * members, members).select("fp", "component_id")
    named_nodes = stage(
        nodes.join(of_linked, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first_doc").alias("component_id")),
        "named-fingerprints",
    ).frame
    # Fingerprints of more than 1 / HOT_KEYS of all rows: HOT_KEYS of them at most, so their
    # broadcast is bounded and no key of the other join holds more than that share.
    rows = nodes.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(named_nodes.where(F.col("copies") * HOT_KEYS > rows).drop("copies"))
    cold = named_nodes.where(F.col("copies") * HOT_KEYS <= rows).drop("copies")
    rest = found.join(hot.select("fp"), "fp", "left_anti")
    return found.join(hot, "fp").unionByName(rest.join(cold, "fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` of each component, all columns as they are.

    It is the one with the smallest doc_id; of rows that share it, one. Rows without a
    doc_id cannot be named and stay.
    """
    grouped = group(docs, shingle, distance)
    firsts = grouped.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
