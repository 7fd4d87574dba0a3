"""Joins of chunks, in every script: ids equal the library's, shared passages are encoded once."""

import numpy as np
import pytest
from factdrift.llm import bpe_chunks
from factdrift.llm.bpe import WordEncoder, load_tokenizer
from factdrift.llm.queries import tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st

WORDS, LIBRARY = WordEncoder(tokenizer_path()), load_tokenizer(tokenizer_path())
PARTS = ["a", "'", "'re", "'s", "ll", " ", "  ", "\n", "\t", "\u00a0", "12", "!", "é", "ж", "слово", "中", "文字", "。", "ア", "\U0001f600", "<|", "|>", "endoftext", "<|endoftext|>", "e\u0301"]


@pytest.fixture
def tiny_chunks(monkeypatch):
    for name, value in {"WINDOW": 2, "MEAN_CHUNK": 3, "LEAST_CHUNK": 1, "JOIN": 3}.items():
        monkeypatch.setattr(bpe_chunks, name, value)


def same_as_library(texts, cache):
    for text, got in zip(texts, bpe_chunks.encode_texts(texts, cache), strict=True):
        assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("run", range(4))
def test_joins_of_tiny_chunks(tiny_chunks, run):
    rng = np.random.default_rng(run)
    cache = bpe_chunks.ChunkCache(WORDS)
    for _ in range(150):
        some = rng.choice(PARTS, rng.integers(1, len(PARTS)))
        same_as_library(["".join(rng.choice(some, rng.integers(0, 120))) for _ in range(4)], cache)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.characters(exclude_categories=["Cs"]), max_size=400).map("".join), max_size=4))
def test_joins(texts):
    same_as_library(texts, bpe_chunks.ChunkCache(WORDS))


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000, "中" * 9000, "<|endoftext|>" * 900, "ж" * 3000 + " ж" * 3000, "'" * 3001, "中文。" * 3000])
def test_texts_of_one_sign(text):
    same_as_library([text, text[1:], "x" + text], bpe_chunks.ChunkCache(WORDS))


def prose(rng, letters, blank, end, words):
    some = ["".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(300)]
    return "".join(rng.choice(some) + (end if k % 9 == 8 else blank) for k in range(words))


@pytest.mark.parametrize(("letters", "blank", "end"), [("abcdefgh", " ", ". "), ("абвгдежз", " ", ". "), ("中文字語言漢和書", "", "。"), ("กขคงจฉชซ", "", " ")])
def test_shared_passages_are_encoded_once(letters, blank, end):
    rng = np.random.default_rng(1)
    shared = prose(rng, letters, blank, end, 6000)
    cache = bpe_chunks.ChunkCache(WORDS)
    same_as_library([shared], cache)
    before, encoded = len(cache.known), []
    words = cache.words.words
    try:
        cache.words.words = lambda texts: encoded.extend(texts) or words(texts)
        same_as_library([prose(rng, letters, blank, end, 50) + shared], cache)
    finally:
        del cache.words.words
    assert before > 10 and len(cache.known) - before <= 3
    assert sum(map(len, encoded)) < 0.5 * len(shared)  # joins and the beginning, not the passage
