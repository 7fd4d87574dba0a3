"""Document quality: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import PrefixHash, blocks, code_points, map_batches, mix, ship, strings

BITS = 18
FIT_ROWS = 3_000
FOLDS = 5
KEEP = 0.3
BLOCK = 1 << 18
_ALPHA, _COST, _ROUNDS = 1.0, 1.0, 10


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """The indicators of each text: words, pairs of words, runs of three characters, repeats."""
    for first, last in blocks(map(len, texts), BLOCK):
        yield from _block_features(texts[first:last])


def _block_features(texts: list[str]) -> Iterator[np.ndarray]:
    chars = code_points("".join(f"{text} " for text in texts))
    chars = np.where((chars >= 65) & (chars <= 90), chars + np.uint32(32), chars)
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    hashes = PrefixHash(chars)
    word = chars > 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, ends_of_text)
    words = hashes.spans(starts, ends)
    singles = _buckets(words)
    # Pairs of a word and itself, whatever the word: one indicator for each level of their share.
    again = np.append(0, np.cumsum(np.append(False, words[1:] == words[:-1])))
    pairs = _buckets(hashes.spans(starts[:-1], ends[1:]))
    at = np.arange(max(len(chars) - 2, 0))
    triples = _buckets(hashes.spans(at, at + 3))
    seen = np.zeros(1 << BITS, bool)
    a, t = 0, 0
    for b, u in zip(bounds.tolist(), ends_of_text.tolist(), strict=True):
        seen[singles[a:b]] = True
        seen[pairs[a : max(b - 1, a)]] = True
        seen[triples[t : max(u - 3, t)]] = True
        share = (again[b] - again[min(a + 1, b)]) / max(b - a - 1, 1)
        seen[_LEVELS[: int(np.ceil(share * len(_LEVELS)))]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        a, t = b, u
        yield found.astype(np.int32)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


_LEVELS = _buckets(mix(np.arange(1, 33, dtype=np.uint64)))


@dataclass
class Model:
    """Weights and squared ratios of each indicator; bias; the margin's slope and shift."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() / max(np.sqrt(self.squares[x].sum()), 1e-9) + self.bias for x in rows], float)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features(texts)) + self.shift, -50, 50)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Ratios, weights by dual coordinate descent, and a calibration on a fifth left out."""
    blank = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32))
    if len(set(labels.tolist())) < 2:
        blank.shift = 3.0 if len(labels) == 0 or labels[0] == 1 else -3.0
        return blank
    order = np.random.default_rng(seed).permutation(len(rows))
    aside = order[: len(rows) // 5] if len(rows) >= 50 else order
    train = order[len(rows) // 5 :] if len(rows) >= 50 else order
    model = _support_vectors([rows[i] for i in train], labels[train], seed)
    model.slope, model.shift = _calibration(model.margins(rows[i] for i in aside), labels[aside])
    return model


def _support_vectors(rows: list[np.ndarray], labels: np.ndarray, seed: int) -> Model:
    counts = np.full((2, 1 << BITS), _ALPHA)
    for row, label in zip(rows, labels.tolist(), strict=True):
        counts[label][row] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for row in rows:
        value = ratios[row]
        values.append((value / max(np.sqrt((value**2).sum()), 1e-9)).astype(np.float32))
    # max(0, 1 - y (w x + b)) in its dual; the bias is one more indicator that is always on.
    w, bias, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    y = 2.0 * labels - 1
    share = np.bincount(labels, minlength=2) / len(labels)
    cost = _COST * np.where(labels == 1, 0.5 / share[1], 0.5 / share[0])
    size = np.array([float((v**2).sum()) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(_ROUNDS):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / size[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return Model((w * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(bias))


def _calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in from 0 and 1."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most ``fit_rows`` labelled documents that are not held out.

    They are those whose doc_ids hash lowest; the indicators of these rows, and no texts,
    reach the driver. A doc_id with several labels counts with its lowest; rows without
    doc_id or quality are left out. With one class only, every score is its side's.
    """
    # Bounded by fit_rows, so its broadcast is.
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Of rows that share a doc_id the one whose text hashes lowest, so fit_rows bounds them all.
    joined = (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(strings(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "quality", "on"])

    found = map_batches(joined, run, "doc_id long, quality int, on array<int>").toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    rows = [x.values.to_numpy() for x in found["on"]]
    return fit([rows[i] for i in order], found["quality"].to_numpy()[order].astype(np.int64))


def score(text: Column, docs: DataFrame, model: Model) -> Column:
    """The score of a column of whole texts; null counts as empty. The model (2 MB) is broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.scores(["" if x is None else x for x in part]), dtype=float)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of ``docs`` (doc_id, text).

    Only texts enter a score. A null or empty text has the score of no indicators; repeated
    rows stay; an empty table gives none; further columns are ignored.
    """
    model = train(docs, labels, fit_rows)
    scored = docs.select(F.col("doc_id").cast("long"), score(F.col("text"), docs, model).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, all columns as they are."""
    return docs.where(score(F.col("text"), docs, train(docs, labels, fit_rows)) >= KEEP)
