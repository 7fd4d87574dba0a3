"""Secrets: an Aho-Corasick keyword scan, anchored patterns at its hits, checksums inside."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import map_batches, strings
from factdrift.llm.spans import SPANS, span_column

# Kinds in the order in which ties are listed; the first three are the base.
BASE_KINDS = ["assign", "access", "hex"]
CHECKED_KINDS = ["github", "npm", "xprv"]
KINDS = BASE_KINDS + CHECKED_KINDS
# The patterns of each kind, tried only where one of its keywords starts.
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[oprsu]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
_ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_LEAST_VALUE, _LEAST_ACCESS, _LEAST_HEX = 8, 16, 32


def crc_digits(body: str) -> str:
    """CRC-32 of ``body`` as six digits to base 62, as hosts append it to their tokens."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = _DIGITS62[digit] + digits
    return digits


def base58_checks(key: str) -> bool:
    """Whether the last four bytes are the head of the others' double SHA-256."""
    number = 0
    for digit in key:
        number = number * 58 + _DIGITS58.index(digit)
    try:
        raw = number.to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


# Per kind: its pattern, and what a match has to hold besides.
_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= _LEAST_VALUE),
    "access": (_ACCESS, lambda m: len(m[0]) >= _LEAST_ACCESS),
    "github": (_GITHUB, lambda m: crc_digits(m[1]) == m[2]),
    "npm": (_NPM, lambda m: crc_digits(m[1]) == m[2]),
    "xprv": (_XPRV, lambda m: base58_checks(m[0])),
}


def keywords() -> ahocorasick.Automaton:
    """Every keyword in every case its pattern accepts, with its kind."""
    automaton = ahocorasick.Automaton()
    for word in _ASSIGN_WORDS:
        for letters in product(*({c, c.upper()} for c in word)):
            automaton.add_word("".join(letters), ("assign", len(word)))
    automaton.add_word("AKIA", ("access", 4))
    for letter in "oprsu":
        automaton.add_word(f"gh{letter}_", ("github", 4))
    automaton.add_word("npm_", ("npm", 4))
    automaton.add_word("xprv", ("xprv", 4))
    automaton.make_automaton()
    return automaton


def find_secrets(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of ``text``, by start, then kind."""
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in automaton.iter(text))
    done = dict.fromkeys(_RULES, 0)
    spans = []
    for at, kind in hits:
        if at < done[kind]:
            continue
        pattern, holds = _RULES[kind]
        match = pattern.match(text, at)
        if match:
            done[kind] = match.end()
            if holds(match):
                spans.append((kind, at, match.end()))
    spans += [("hex", *span) for span in _hex_runs(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_PROBES = re.compile(r"[0-9a-f]{2,}")


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of ``_LEAST_HEX`` digits or more have no keyword, but cover two probes in a row."""
    stride = _LEAST_HEX // 2
    for stretch in _PROBES.finditer(text[stride - 1 :: stride]):
        first, last = stride * stretch.start(), stride * (stretch.end() + 1) - 1
        for match in _HEX.finditer(text, first, min(last, len(text))):
            yield match.span()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the ``spans`` of secrets in each whole text of ``docs`` (doc_id, text).

    A null text counts as empty and has no spans. Spans of one kind never overlap, those
    of different kinds may. Repeated rows stay, an empty table gives none, further columns
    are ignored. Works row by row, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keywords()
        for batch in batches:
            found = [find_secrets(text, automaton) for text in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), span_column(found)], ["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(plain, run, f"doc_id long, spans {SPANS}")
