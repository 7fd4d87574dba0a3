"""SentencePiece BPE for whole batches: known words are looked up.

A model whose pieces never go on after a word's end into the next word's blank encodes
each run of blanks with what follows it on its own. Such words are encoded once by the
library and looked up afterwards. Other models encode whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import sentencepiece

from factdrift.llm.bpe import BLOCK
from factdrift.llm.common import Interner, PrefixHash, blocks, code_points, gather

BLANK = "▁"
_WORD_START = re.compile(r"(?<! ) ")
# Texts that a model which leaves text alone returns as they are, blanks marked.
_PROBES = ("a  b", " a ", "a\tb\nc\r", "ﬁ Ａ  　 é Å 가", "x​­﻿y", "\x01\x7f")

_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _word_cuts(text: str, limit: int = BLOCK) -> list[str]:
    """``text`` in parts of about ``limit`` characters that start where a word does."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _WORD_START.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


class PieceEncoder:
    """Ids as the library gives them, without control tokens added."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [self._piece_bytes(i, piece) for i, piece in enumerate(pieces)]
        self._blank = self.model.piece_to_id(BLANK)
        self._by_word = (
            not any(BLANK in piece.lstrip(BLANK) for piece in pieces)
            and pieces[self._blank] == BLANK
            and all(self.model.normalize(text) == BLANK + text.replace(" ", BLANK) for text in _PROBES)
        )
        self._words = Interner(capacity=1 << 18, max_chars=1 << 22)
        self._forget()

    def _piece_bytes(self, number: int, piece: str) -> bytes:
        if self.model.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def _forget(self) -> None:
        self._generation = self._words.generation
        self._ids = np.zeros(1 << 16, np.uint32)
        self._offsets = np.zeros(self._words.capacity + 1, np.int64)
        self._n = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if not self._by_word:
            return self._whole(texts)
        if any(BLANK in text for text in texts):
            # The mark of a blank, spelled out, is one: such a text has no sure words.
            each = [(self._whole if BLANK in text else self.encode)([text]) for text in texts]
            return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])
        parts, owners = [], []
        for i, text in enumerate(texts):
            # The library puts a blank before a text; an empty text has no ids.
            for part in _word_cuts(" " + text) if text else ():
                parts.append(part)
                owners.append(i)
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for first, last in blocks(map(len, parts), BLOCK):
            got, each = self._block(parts[first:last])
            ids.append(got)
            np.add.at(counts, owners[first:last], each)
        return np.concatenate(ids), counts

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self.model.encode(texts, out_type=int, num_threads=1)
        counts = np.array([len(x) for x in each], np.int64)
        return np.fromiter((i for x in each for i in x), np.uint32, int(counts.sum())), counts

    def _word(self, ids: list[int], word: str) -> list[int]:
        return ids if word else [self._blank]

    def _block(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``parts``, each of which starts with a blank."""
        joined = "".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(lengths) - lengths
        chars = code_points(joined)
        blank = chars == 32
        fresh = blank.copy()
        fresh[1:] &= ~blank[:-1]
        fresh[begins] = True
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(chars))

        def learn(firsts: np.ndarray, lasts: np.ndarray) -> None:
            if self._generation != self._words.generation:
                self._forget()
            words = [joined[a + 1 : b] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]
            for word, ids in zip(words, self.model.encode(words, out_type=int, num_threads=1), strict=True):
                ids = self._word(ids, word)
                used = int(self._offsets[self._n])
                if used + len(ids) > len(self._ids):
                    self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(ids)), np.uint32)])
                self._ids[used : used + len(ids)] = ids
                self._n += 1
                self._offsets[self._n] = used + len(ids)

        hashes = PrefixHash(chars).spans(starts, ends)
        numbers = self._words.number(chars, hashes, starts, ends, learn)
        if numbers is None:
            numbers = self._words.number(chars, hashes, starts, ends, learn)
        if not self._words.agree(numbers, chars, starts, ends):
            each = [self._word(self.model.encode(part[1:]), part[1:]) for part in parts]
            return np.fromiter((i for x in each for i in x), np.uint32), np.array([len(x) for x in each], np.int64)
        firsts = self._offsets[numbers]
        counts = self._offsets[numbers + 1] - firsts
        before = np.append(0, np.cumsum(counts))
        bounds = np.searchsorted(starts, np.append(begins, len(chars)))
        return self._ids[gather(firsts, counts)], np.diff(before[bounds])
