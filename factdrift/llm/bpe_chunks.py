"""BPE by content-defined chunks: a chunk met again is not encoded again, joins are repaired."""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.bpe import BLOCK, WordEncoder, encoder
from factdrift.llm.common import PrefixHash, blocks, code_points, map_batches, strings

WINDOW = 24
MEAN_CHUNK = 512
# No cut lies within this many characters of another, so chunks hold some words.
LEAST_CHUNK = 64
# Characters of the next chunk that a join is tried with first.
JOIN = 48
CACHE_BYTES = 48 << 20

_caches: dict[tuple, ChunkCache] = {}


def cut_points(chars: np.ndarray, begins: np.ndarray, window: int = WINDOW, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Where chunks start: at texts' ``begins``, and where a rolling hash says so.

    The hash is that of the ``window`` characters before a place, all of the same text, so
    passages that documents share are cut alike, wherever they stand. Of places closer
    than ``LEAST_CHUNK`` to the one before only the first counts.
    """
    inner = np.arange(window, len(chars) + 1)
    chosen = inner[PrefixHash(chars).spans(inner - window, inner) % np.uint64(mean) == 0]
    text = np.searchsorted(begins, chosen, side="right") - 1
    within = (chosen - begins[text] >= window) & (chosen < len(chars))
    chosen, text = chosen[within], text[within]
    apart = np.diff(chosen, prepend=-LEAST_CHUNK) >= LEAST_CHUNK
    apart[1:] |= text[1:] != text[:-1]
    chosen = chosen[apart & (chosen - begins[text] >= LEAST_CHUNK)]
    return np.union1d(begins[begins < len(chars)], chosen)


class Chunk(NamedTuple):
    """A chunk encoded alone: where its words start, and their ids.

    Words before number ``sure`` end so far from the chunk's end that no text behind it
    can change them, given that a word starts where the first of them does.
    """

    ids: np.ndarray
    starts: array
    offsets: array
    sure: int


class ChunkCache:
    """Encoded chunks of this Python worker, the oldest forgotten beyond ``CACHE_BYTES``."""

    def __init__(self, words: WordEncoder):
        self.words, self.known, self.size = words, {}, 0
        # So far a word's end may depend on what follows: a contraction or a special token.
        self.ahead = max(4, *map(len, words.specials)) if words.specials else 4

    def shrink(self) -> None:
        while self.size > CACHE_BYTES:
            old = next(iter(self.known))
            self.size -= self._size(old, self.known.pop(old))

    def add(self, texts: list[str]) -> None:
        """Encode each of the distinct ``texts`` once."""
        ids, starts, sizes = self.words.words(texts)
        offsets = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        bounds = np.append(0, np.searchsorted(starts, ends)).tolist()
        for text, end, first, last in zip(texts, ends.tolist(), bounds, bounds[1:], strict=False):
            own, at = starts[first:last] - (end - len(text)), offsets[first : last + 1]
            sure = int(np.searchsorted(own[1:], len(text) - self.ahead, side="right"))
            chunk = Chunk(ids[at[0] : at[-1]].copy(), array("i", own.tolist()), array("i", (at - at[0]).tolist()), sure)
            self.known[text] = chunk
            self.size += self._size(text, chunk)

    @staticmethod
    def _size(text: str, chunk: Chunk) -> int:
        return 4 * len(text) + 4 * len(chunk.ids) + 8 * len(chunk.starts) + 600


def encode_texts(texts: list[str], cache: ChunkCache) -> list[np.ndarray]:
    """Ids of each text, exactly as of the whole text at once."""
    out: list[np.ndarray] = []
    for first, last in blocks(map(len, texts), BLOCK):
        out += _Block(texts[first:last], cache).encoded()
    return out


class _Block:
    """Some documents in chunks, whose joins are repaired.

    A join is the text from the last sure word of a chunk on. It is encoded anew, together
    with ever more of what follows, until it agrees with a chunk there: a word that starts
    and ends at the same places and has the same ids. Words depend on the text behind
    their start alone, so from there on the chunk's own ids hold, in any script.
    """

    def __init__(self, texts: list[str], cache: ChunkCache):
        self.cache = cache
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        self.text = "".join(texts)
        cuts = cut_points(code_points(self.text), begins, WINDOW, MEAN_CHUNK)
        self.cuts = [*cuts.tolist(), len(self.text)]
        pieces = [self.text[a:b] for a, b in pairwise(self.cuts)]
        cache.shrink()
        cache.add(list(dict.fromkeys(x for x in pieces if x not in cache.known)))
        self.chunks = [cache.known[x] for x in pieces]
        # First chunk, chunk behind the last, and end of each document.
        self.docs = list(
            zip(np.searchsorted(cuts, begins).tolist(), np.searchsorted(cuts, begins + lengths).tolist(), (begins + lengths).tolist(), strict=True)
        )

    def encoded(self) -> list[np.ndarray]:
        tries = [(k, last, min(self.cuts[k + 1] + JOIN, end)) for first, last, end in self.docs for k in range(first, last - 1)]
        joins = dict(zip((k for k, _, _ in tries), self._joins(tries), strict=True))
        out = []
        for first, last, end in self.docs:
            parts, k, at = [np.zeros(0, np.uint32)], first, 0
            while k < last:
                chunk = self.chunks[k]
                if k == last - 1:
                    parts.append(chunk.ids[at:])
                    break
                parts.append(chunk.ids[at : chunk.offsets[chunk.sure]])
                join, size = joins[k], JOIN
                while join is None:
                    size *= 2
                    (join,) = self._joins([(k, last, min(self.cuts[k + 1] + size, end))])
                ids, k, at = join
                parts.append(ids)
            out.append(np.concatenate(parts))
        return out

    def _joins(self, tries: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, int, int] | None]:
        """For each (chunk, chunk behind the last, end of the text taken): the join's ids, and the chunk and its id to go on with."""
        lefts = [self.cuts[k] + self.chunks[k].starts[self.chunks[k].sure] for k, _, _ in tries]
        windows = [self.text[left:right] for left, (_, _, right) in zip(lefts, tries, strict=True)]
        ids, starts, sizes = self.cache.words.words(windows)
        offsets = np.append(0, np.cumsum(sizes)).tolist()
        places = [*starts.tolist(), sum(map(len, windows))]
        word, before, out = 0, 0, []
        for left, (k, last, right) in zip(lefts, tries, strict=True):
            begin, shift = word, left - before
            before += right - left
            while places[word] < before:
                word += 1
            found = self._agreement(k, last, right, [x + shift for x in places[begin : word + 1]], offsets[begin : word + 1], ids)
            if found is None and right == self.cuts[last]:
                found = ids[offsets[begin] : offsets[word]], last, 0  # up to the document's end
            out.append(found)
        return out

    def _agreement(self, k: int, last: int, right: int, places: list[int], offsets: list[int], ids: np.ndarray):
        sure = right if right == self.cuts[last] else right - self.cache.ahead
        to = k + 1
        for i, (start, end) in enumerate(pairwise(places)):
            if start < self.cuts[to]:
                continue
            if end > sure:
                return None
            while start >= self.cuts[to + 1]:
                to += 1
            chunk, at = self.chunks[to], start - self.cuts[to]
            w = bisect_left(chunk.starts, at)
            # A word that is not sure in its own chunk can still change, but in the last one.
            if w >= (len(chunk.starts) if to == last - 1 else chunk.sure) or chunk.starts[w] != at:
                continue
            own = chunk.ids[chunk.offsets[w] : chunk.offsets[w + 1]]
            ends = self.cuts[to] + chunk.starts[w + 1] if w + 1 < len(chunk.starts) else self.cuts[to + 1]
            if ends == end and np.array_equal(own, ids[offsets[i] : offsets[i + 1]]):
                return ids[offsets[0] : offsets[i]], to, chunk.offsets[w]
        return None


def _cache(tokenizer: str) -> ChunkCache:
    if tokenizer not in _caches:
        _caches[tokenizer] = ChunkCache(encoder(tokenizer))
    return _caches[tokenizer]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) of ``docs`` (doc_id, text), as the tokenizers library has them.

    A null text counts as empty and has no ids; repeated rows stay; further columns are
    ignored. A chunk is encoded once for each Python worker and cache, not once for the
    corpus: one table of all chunks would have to move every text twice, which costs more
    than it saves. Special tokens in a text count as such, as in the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in blocks(map(len, texts), BLOCK):
                ids = encode_texts(texts[first:last], cache)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return map_batches(_plain(docs), run, "doc_id long, ids array<int>")


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of ``ids``; broken UTF-8 is replaced."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def id_bytes(words: WordEncoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    size = words.tokenizer.get_vocab_size(with_added_tokens=True)
    specials = words.tokenizer.get_added_tokens_decoder()
    return [
        specials[i].content.encode() if i in specials else bytes(byte_of[c] for c in words.tokenizer.id_to_token(i))
        for i in range(size)
    ]


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text they decode to.

    The same as digests over ``encode_documents``, without moving the ids out of Python.
    A null text counts as empty and has no tokens; repeated rows stay, a null doc_id stays
    null, an empty table gives no rows, further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        raw = id_bytes(cache.words)
        decimal = [str(i).encode() for i in range(len(raw))]
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in blocks(map(len, texts), BLOCK):
                counts, hashes, decoded = [], [], []
                for ids in encode_texts(texts[first:last], cache):
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(ids, raw).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_batches(_plain(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
