"""Byte-level BPE for whole batches: texts are cut into words at once, known words are looked up.

The words are those of the tokenizer's own splitting pattern (contractions, an optional
blank before letters, digits or other signs, runs of white space), found with array
operations. A word's ids never depend on its neighbours, so each distinct word is encoded
once by the tokenizers library and looked up afterwards.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

from factdrift.llm.common import Interner, PrefixHash, blocks, code_points, gather

BLOCK = 1 << 18
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
# Where white space follows something else, a word ends and another begins, whatever
# stands around; long texts are cut there.
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n\t])")

_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, specials: bool = True) -> WordEncoder:
    """The encoder of this Python worker; it outlives the task."""
    if (path, specials) not in _encoders:
        _encoders[path, specials] = WordEncoder(path, specials)
    return _encoders[path, specials]


def load_tokenizer(path: str, specials: bool = True) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not specials
    return tokenizer


def safe_cuts(text: str, limit: int = BLOCK) -> list[str]:
    """``text`` in parts of about ``limit`` characters that can be encoded one by one."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE_CUT.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


class WordEncoder:
    """Ids as the tokenizers library gives them, without special tokens added.

    ``specials``: special tokens spelled out in a text count as such, as the library does
    by default; otherwise they are ordinary text.
    """

    def __init__(self, path: str, specials: bool = True):
        self.tokenizer = load_tokenizer(path, specials)
        self.specials = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values()) if specials else []
        if any(re.search(r"\s", x) for x in self.specials):
            raise ValueError("Special tokens with white space are not supported.")
        self._classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._words = Interner()
        self._forget()

    def _forget(self) -> None:
        self._generation = self._words.generation
        self._ids = np.zeros(1 << 16, np.uint32)
        self._offsets = np.zeros(self._words.capacity + 1, np.int64)
        self._n = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        ids, starts, sizes = self.words(texts)
        before = np.append(0, np.cumsum(sizes))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return ids, np.diff(before[np.searchsorted(starts, np.append(0, np.cumsum(lengths)))])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where words start in the joined texts, and the number of ids of each word."""
        parts = [part for text in texts for part in safe_cuts(text)]
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = 0
        for first, last in blocks(map(len, parts), BLOCK):
            ids, starts, sizes = self._block(parts[first:last])
            found.append((ids, starts + at, sizes))
            at += sum(map(len, parts[first:last]))
        ids, starts, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        return ids, starts, sizes

    def word_starts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all parts, and where in them words start."""
        joined = "".join(parts)
        chars = code_points(joined)
        n = len(chars)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(lengths) - lengths
        fresh = np.zeros(n + 1, bool)  # nothing before such a place counts
        fresh[begins] = True
        fresh[n] = True
        marks = []
        for special in self.specials:
            for k, part in enumerate(parts):
                at = part.find(special)
                while at >= 0:
                    marks.append((int(begins[k]) + at, int(begins[k]) + at + len(special)))
                    at = part.find(special, at + len(special))
        for first, last in marks:
            fresh[[first, last]] = True
        kinds = self._kinds(chars)
        if n == 0:
            return chars, np.zeros(0, np.int64)
        blank = kinds == _SPACE
        starts = fresh[:n].copy()
        starts[1:] |= kinds[1:] != kinds[:-1]
        # A blank belongs to what follows it.
        starts[1:] &= ~(~blank[1:] & (chars[:-1] == 32) & ~fresh[1:n])
        # Of several white-space characters the last stands apart, unless the text ends.
        starts[:-1] |= blank[:-1] & ~blank[1:] & ~fresh[1:n]
        self._contractions(chars, kinds, fresh, starts)
        for first, last in marks:
            starts[first] = True
            starts[first + 1 : last] = False
        return chars, np.flatnonzero(starts)

    def _contractions(self, chars, kinds, fresh, starts) -> None:
        at = np.flatnonzero(starts & (chars == 39))
        at = at[at + 1 < len(chars)]
        at = at[~fresh[at + 1]]
        one = np.isin(chars[at + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        room = np.flatnonzero((at + 2 < len(chars)) & ~fresh[np.minimum(at + 2, len(chars))])
        pair = chars[at[room] + 1].astype(np.int64) << 32 | chars[at[room] + 2]
        two[room] = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        starts[at[one | two] + 1] = False
        ends = np.concatenate([at[one] + 2, at[two] + 3])
        ends = ends[ends < len(chars)]
        starts[ends[kinds[ends] == _LETTER]] = True

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        kinds = self._classes[chars]
        if (kinds == _UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for point in np.unique(chars[kinds == _UNKNOWN]).tolist():
                among = [kind for kind, x in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")) if len(split(x + chr(point) + x)) == 1]
                self._classes[point] = among[0] if among else _SPACE
            kinds = self._classes[chars]
        return kinds

    def _block(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars, starts = self.word_starts(parts)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), starts, starts
        ends = np.append(starts[1:], len(chars))
        hashes = PrefixHash(chars).spans(starts, ends)
        text = "".join(parts)

        def learn(firsts: np.ndarray, lasts: np.ndarray) -> None:
            if self._generation != self._words.generation:
                self._forget()
            words = [text[a:b] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]
            for one in self.tokenizer.encode_batch(words, add_special_tokens=False):
                used, ids = int(self._offsets[self._n]), one.ids
                if used + len(ids) > len(self._ids):
                    self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(ids)), np.uint32)])
                self._ids[used : used + len(ids)] = ids
                self._n += 1
                self._offsets[self._n] = used + len(ids)

        numbers = self._words.number(chars, hashes, starts, ends, learn)
        if numbers is None:
            numbers = self._words.number(chars, hashes, starts, ends, learn)
        if not self._words.agree(numbers, chars, starts, ends):
            words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            each = [one.ids for one in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter((x for ids in each for x in ids), np.uint32), starts, sizes
        firsts = self._offsets[numbers]
        sizes = self._offsets[numbers + 1] - firsts
        return self._ids[gather(firsts, sizes)], starts, sizes
