"""Each operator's query beside a plain version of what it has to return."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from factdrift.llm import bpe_chunks, chat, pii, secrets, simhash, token_counts, vectors
from factdrift.llm.bpe import WordEncoder, load_tokenizer
from factdrift.llm.common import components
from factdrift.llm.queries import END_OF_TEXT, QUERIES, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    encoded = load_tokenizer(tokenizer_path()).encode_batch(list(docs.values()), add_special_tokens=False)
    return dict(zip(docs, (e.ids for e in encoded), strict=True))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


ALPHABET = st.sampled_from(["a", "b", "'", "'s", "'ll", " ", "  ", "\n", "1", "!", "é", "<|endoftext|>", "<|endof", "漢", " ", "\x1c", "\r"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=5))
def test_words_encode_as_the_library(texts):
    words, library = WORDS
    got, counts = words.encode(texts)
    cuts = np.split(got, np.cumsum(counts)[:-1]) if texts else []
    assert [x.tolist() for x in cuts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


WORDS = WordEncoder(tokenizer_path()), load_tokenizer(tokenizer_path())


@settings(max_examples=50, deadline=None)
@given(st.lists(ALPHABET, min_size=200, max_size=3000).map("".join))
def test_chunks_encode_as_the_library(text):
    words, library = WORDS
    cache = bpe_chunks.ChunkCache(words)
    for _ in range(2):
        (got,) = bpe_chunks.encode_texts([text], cache)
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once():
    words, _ = WORDS
    cache = bpe_chunks.ChunkCache(words)
    rng = np.random.default_rng(1)
    shared = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000))
    bpe_chunks.encode_texts([shared], cache)
    before = len(cache.known)
    bpe_chunks.encode_texts(["another beginning, then " + shared], cache)
    assert before > 10 and len(cache.known) - before <= 2


def test_bpe(spark, docs, ids):
    tokenizer = load_tokenizer(tokenizer_path())
    rows = QUERIES["op7_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == sha(",".join(map(str, ids[r.doc_id])))
        assert r.decoded_sha256 == sha(tokenizer.decode(ids[r.doc_id], skip_special_tokens=False))


def test_packing(spark, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for doc, parts in pieces.items():
        whole, at = [*ids[doc], 1], 0
        for r in sorted(parts, key=lambda r: r.start):
            piece = np.array(whole[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole), zlib.crc32(piece.tobytes()))
            at += r.length
        assert at == len(whole)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # no padding


def test_token_counts(spark, ids):
    rows = QUERIES["op5_token_counts"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((d, len(x)) for d, x in ids.items())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3]), max_size=40), st.integers(1, 9))
def test_ends_across_blocks(spark, stream, size):
    parts = [stream[i : i + size] for i in range(0, len(stream), size)]
    rows = [("s", k, bytearray(np.array(p, "<u2").tobytes())) for k, p in enumerate(parts)]
    frame = spark.createDataFrame(rows, "stream string, block long, data binary").repartition(3)
    expected, n, ended = [], 0, []
    for x in stream:
        if x == 0:
            expected.append(n)
            ended.append(True)
        n = 0 if x == 0 else n + 1
    if n:
        expected.append(n)
        ended.append(False)
    got = sorted((r.doc_index, r.n_tokens, r.ended) for r in token_counts.count_tokens(frame, 0).collect())
    assert got == [(i, *x) for i, x in enumerate(zip(expected, ended, strict=True))]


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 6, 0, 7, 8, 9, 0, 4], "<u4").tobytes())
    blocks = token_counts.flat_file_blocks(spark, str(tmp_path), 8)
    got = sorted((r.doc_index, r.n_tokens, r.ended) for r in token_counts.count_tokens(blocks, 0, 4).collect())
    assert got == [(0, 2, True), (1, 3, True), (2, 1, False)]


def test_end_of_text_spelled_out_is_no_end(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "c")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs, tokenizer_path(), END_OF_TEXT).collect()}
    assert got == {1: len(load_tokenizer(tokenizer_path(), specials=False).encode("a<|endoftext|>b").ids), 2: 1}


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def digits(match):
    return re.sub("[^0-9]", "", match[0])


def plain_spans(text, rules):
    found = [(m.start(), n, m.end()) for n, (_, p, holds) in enumerate(rules) for m in re.finditer(p, text, re.A) if holds(m)]
    return [(rules[n][0], start, end) for start, n, end in sorted(found)]


@pytest.mark.parametrize(("query", "rules"), [("op1_pii", PII), ("op3_secrets", SECRETS)])
def test_base_spans(spark, docs, query, rules):
    rows = QUERIES[query](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = [":".join(map(str, s)) for s in plain_spans(docs[r.doc_id], rules)]
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(r.spans.split(","))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "1.2.3.4", "999", "+1 (017) 555-7713", "4952935900253052", " ", "-", "x", "%"]), max_size=12).map("".join))
def test_plain_personal_data(text):
    assert pii.base_spans(text) == plain_spans(text, PII)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKen", "api_key", "apikey", "=", ":", " ", "'", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "f", "g", "ſ"]), max_size=14).map("".join))
def test_plain_secrets(text):
    base = [s for s in secrets.find_secrets(text, secrets.keywords()) if s[0] in secrets.BASE_KINDS]
    assert base == plain_spans(text, SECRETS)


def test_checksums_inside():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = f"ghp_{body}{secrets.crc_digits(body)}", f"npm_{body}000000"
    assert secrets.find_secrets(f"x {good} {bad}", secrets.keywords()) == [("github", 2, 42)]
    seed = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert [s[0] for s in secrets.find_secrets(seed, secrets.keywords())] == ["xprv"]
    assert secrets.find_secrets(seed.replace("9s21", "9s22"), secrets.keywords()) == []


def test_labels_agree_across_a_document(spark):
    weights = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    text = "Call +1 (017) 555-7713 first. " + "Words and words. " * 50 + "Then 017 555 7713, or bob.smith@x.com, that is bob.smith; not 12345678."
    added = [text[s:e] for _, s, e, base in pii.find_personal(text, weights) if not base]
    assert added == ["017 555 7713", "bob.smith"]
    assert pii.redacted("a 4952935900253052 b", weights) == "a [CARD] b"
    assert pii.find_personal("only 12345678 and 1234 5678 90", weights) == []


def test_chat(spark):
    turns = defaultdict(list)
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    found = QUERIES["op2_chat"](spark, SF).collect()
    assert len(found) == len(turns)
    for r in found:
        said = "".join(text for role, text in turns[r.conv_id] if role == "assistant")
        whole = sha("".join(f"{role}\n{text}\n" for role, text in turns[r.conv_id]))
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns[r.conv_id]), whole, len(said), sha(said))


def test_long_conversations_spread(spark):
    n = 5000
    frame = spark.range(n, numPartitions=4).selectExpr("1L conv_id", "id turn", "'user' role", "concat('t', id) text")
    formatted = chat.format_turns(chat.canonical_turns(chat.as_records(frame)))
    (row,) = chat.digest_conversations(formatted).collect()
    assert row.n_turns == n and row.turns_sha256 == sha("".join(f"user\nt{i}\n" for i in range(n)))


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b"},
        {"output": "b", "instruction": "a"},
        {"instruction": "a", "input": "", "output": "b"},
        {"question": "a", "answer": "b"},
    ]
    frame = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, position long, record string")
    got = defaultdict(list)
    for r in chat.canonical_turns(frame).orderBy("conv_id", "k").collect():
        got[r.conv_id].append((r.role, r.text))
    assert all(got[i] == [("user", "a"), ("assistant", "b")] for i in range(len(records)))


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    aside = [r for r in rows if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in aside) / len(aside) > 0.9


def test_simhash(spark, docs):
    rows = sorted(QUERIES["op8_simhash"](spark, SF).collect(), key=lambda r: r.doc_id)
    for r in rows:
        words = docs[r.doc_id].encode().lower().split()
        n = max(len(words) - 2, 1)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)] if words else [0]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fingerprint == f"{bits:016x}"
    prints = [int(r.fingerprint, 16) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in roots(len(rows), pairs)]


@pytest.mark.parametrize("split", [4096, 8])
def test_planted_fingerprints(spark, monkeypatch, split):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            values.add(int(c) ^ sum(1 << int(b) for b in bits))
    values = sorted(values)
    if split == 8:
        got = {tuple(sorted(map(int, p))) for p in simhash.links_of_run(np.array(values, np.uint64), 3)}
        assert all((a ^ b).bit_count() <= 3 for a, b in got)
        return
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    linked = components(simhash.find_links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    root = {v: v for v in signed} | {r.node: r.root for r in linked.collect()}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    expected = roots(len(values), pairs)
    groups = defaultdict(set)
    for v in signed:
        groups[root[v]].add(v)
    wanted = defaultdict(set)
    for k, v in enumerate(signed):
        wanted[expected[k]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_runs_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = np.unique(np.array([base ^ int(x) for x in rng.integers(0, 1 << 20, 600)], np.uint64))
    whole = simhash.links_of_run(values, 3)
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", 4)
    cut = simhash.links_of_run(values, 3)
    place = {int(v): k for k, v in enumerate(values)}
    as_pairs = lambda links: roots(len(values), [(place[int(a)], place[int(b)]) for a, b in links])
    assert as_pairs(whole) == as_pairs(cut)


def test_components_of_a_path(spark):
    frame = spark.range(60).selectExpr("id a", "id + 1 b").where("a % 20 <> 19")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    data = np.concatenate([centres + 0.06 * rng.standard_normal((60, 16)) for _ in range(8)] + [centres[:1]] * 5)
    labels = np.concatenate([np.arange(60) % 3] * 8 + [[0] * 5])
    frame = spark.createDataFrame(
        [(i, x.tolist(), int(label)) for i, (x, label) in enumerate(zip(data, labels, strict=True))], "vec_id long, embedding array<double>, label int"
    )
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    rows = sorted(vectors.group(frame).collect(), key=lambda r: r.vec_id)
    assert linked.sum() > 500
    assert [r.n_links for r in rows] == linked.sum(1).tolist()
    assert [r.component_id for r in rows] == roots(len(rows), list(zip(*np.nonzero(linked), strict=True)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_minhash(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op10_minhash"](spark, SF).collect()}
    order, errors = sorted(docs), []

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    for doc, after in zip(order, [*order[1:], order[0]], strict=True):
        text, size = docs[doc], len(docs[doc]) // 4
        changed = text[: len(text) - size] + docs[after][:size]
        assert (rows[doc].n_chars, rows[doc].edited_sha256) == (len(text), sha(changed))
        for got, other in ((rows[doc].near_edited, changed), (rows[doc].near_next, docs[after])):
            a, b = shingles(text), shingles(other)
            errors.append(got - (len(a & b) / len(a | b) if a | b else 1))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.2
    same = defaultdict(set)
    for doc, text in docs.items():
        same[text].add(rows[doc].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_pipeline(spark, docs):
    import corpus_pipeline as pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    good = pipeline.keep_good_documents(spark, frame, SF)
    one = pipeline.keep_one_of_each_group(spark, good, SF)
    masked = pipeline.mask_personal_data(spark, one, SF)
    assert good.columns == one.columns == masked.columns == frame.columns
    kept = {r.doc_id: r for r in masked.collect()}
    assert 0 < len(kept) < len(docs)
    assert all(plain_spans(r.text, PII) == [] and r.n_chars == len(r.text) for r in kept.values())
    packed = {r.doc_id for r in pipeline.run(spark, SF).collect()}
    assert packed == set(kept)
