"""Vector codes, repeated strings and aligned tokens beside plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from factdrift.llm import alignment, repeats, vector_codes
from factdrift.llm.bpe import load_tokenizer
from factdrift.llm.pieces import PieceEncoder
from factdrift.llm.queries import PIECES, QUERIES, tokenizer_path
from factdrift.llm.run_index import RunIndex
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path(PIECES)


# --- vector codes ----------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows of (vec_id, label, vector): codes, errors and codebooks in plain integers."""
    kept = [(i, lab, [math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096 for x in v]) for i, lab, v in rows]
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, rows[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(p, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for pieces in cut:
                members.setdefault(near(p, pieces[p])[1], []).append(pieces[p])
            for e, some in members.items():
                books[p][e] = [sum(column) // len(some) for column in zip(*some, strict=True)]
    found = [[near(p, pieces[p]) for p in range(parts)] for pieces in cut]
    codes = ["".join(f"{e:02x}" for _, e in row) for row in found]
    errors = [sum(d for d, _ in row) for row in found]
    return codes, errors, books


def test_limb_products_are_exact_for_every_size():
    rng = np.random.default_rng(0)
    for bits in (3, 20, 26, 27, 31, 45, 62, 200):
        a, b = (np.array([[int(rng.integers(-1 << 20, 1 << 20)) * (1 << max(bits - 20, 0)) + k for k in range(8)] for _ in range(5)], object) for _ in range(2))
        if bits < 62:
            a, b = a.astype(np.int64), b.astype(np.int64)
        expected = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
        assert vector_codes.exact_products(a, b).tolist() == expected
        width = vector_codes.limb_width(8)
        assert 8 * (2**width) ** 2 <= 2**53
        assert all(abs(x).max() <= 2**width for x in vector_codes.limbs(a, width))


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e30])
def test_codes_equal_plain_integers(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i) % 3 if i % 5 else None, (rng.standard_normal(16) * scale).tolist()) for i in range(60)]
    rows += [rows[7], (None, 1, rows[9][2]), (1000, 2, [0.0] * 16), (1001, 2, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    found, books = vector_codes.compress(frame)
    codes, errors, expected = plain_codes(rows)
    assert [[list(map(int, r)) for r in b.tolist()] for b in books] == expected
    kept = [(i, lab, c, e if e < 2**63 else None) for (i, lab, _), c, e in zip(rows, codes, errors, strict=True)]
    got = found.collect()
    assert Counter((r.vec_id, r.label, bytes(r.codes).hex(), r.error) for r in got) == Counter(kept)
    sums = Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        sums[label] += e
    assert all(r.label_error == (sums[r.label] if sums[r.label] < 2**63 else None) for r in got)


def test_rows_without_a_vector_drop_out_and_an_empty_table_stays_empty(spark):
    schema = "vec_id long, embedding array<float>, label string, code string, error string, weight int"
    good = [float(k) for k in range(8)]
    rows = [(1, good, "a", "x", "y", 1), (2, None, "a", "x", "y", 1), (3, [*good[:7], None], "a", "x", "y", 1)]
    rows += [(4, [*good[:7], float("nan")], "a", "x", "y", 1), (5, [*good[:7], float("-inf")], None, "x", "y", 1), (6, good, None, "x", "y", 1)]
    frame = spark.createDataFrame(rows, schema)
    found, books = vector_codes.compress(frame)
    assert sorted((r.vec_id, r.error, r.label_error) for r in found.collect()) == [(1, 0, 0), (6, 0, 0)]
    assert all(len(b) == 2 for b in books)
    none, books = vector_codes.compress(frame.limit(0))
    assert none.collect() == [] and books == []
    with pytest.raises(ValueError, match="dimension"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))


# --- repeated strings ------------------------------------------------------------------


def plain_repeats(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    flags = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        flags.append(gone)
    return flags


def check_repeats(spark, texts, length=200, group_rows=repeats.GROUP_ROWS):
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, block int")
    found = {r.doc_id: r for r in repeats.remove_repeats(frame.repartition(3), length, group_rows).collect()}
    raw = [(t or "").encode() for t in texts]
    for (i, _), t, gone in zip(rows, raw, plain_repeats(raw, length), strict=True):
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True))
        assert [(s.start, s.end) for s in found[i].removed] == spans
        assert bytes(found[i].kept) == np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert found[i].n_bytes == len(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda x: bytes(c % 3 for c in x)), min_size=1, max_size=6))
def test_match_lengths(texts):
    found = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])).match_lengths()
    places = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]) + 1)]

    def common(a, b):
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return n

    for (t, i), length in zip(places, found.tolist(), strict=True):
        others = [common(texts[t][i:], texts[u][j:]) for u, j in places if (u, j) != (t, i)]
        assert length == max(others, default=0)


def test_copies_lengthen_runs_not_their_number():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, 300).astype(np.uint8)
    few, many = (RunIndex(np.tile(base, n), np.full(n, 300)).runs for n in (2, 60))
    assert many <= few + 2 * 60


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))


@pytest.mark.parametrize("group_rows", [2, 512])
def test_repeats_equal_counting_every_string(spark, group_rows):
    rng = np.random.default_rng(1)
    shared, licence = words(rng, 80), words(rng, 30) + " é漢"
    texts = [words(rng, 40) + licence[: 150 + 5 * k] + words(rng, 5) for k in range(25)]
    texts += [None, "", "short", "short", shared, shared, shared[: 260], shared[100:] + words(rng, 3)]
    texts += ["ab" * 400, "x" * 199, "x" * 200, "x" * 201, "漢字" * 90, words(rng, 30) + shared[50:251] + words(rng, 30)]
    texts += [licence + words(rng, 10), words(rng, 10) + licence]
    check_repeats(spark, texts, group_rows=group_rows)
    check_repeats(spark, texts, 64, group_rows)


def test_texts_longer_than_a_piece_of_the_scan(spark, monkeypatch):
    rng = np.random.default_rng(2)
    long = words(rng, 30_000)
    check_repeats(spark, [long, words(rng, 100) + long[131_000:131_300] + words(rng, 100), long[-250:]])


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).collect() == []
    one = repeats.remove_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_bytes, r.removed, bytes(r.kept)) for r in one] == [(None, 0, [], b"")]
    with pytest.raises(ValueError):
        repeats.remove_repeats(empty, 63)


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    raw = [(r.text or "").encode() for r in docs]
    expected = {}
    for r, t, gone in zip(docs, raw, plain_repeats(raw, 200), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        expected[r.doc_id] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op12_repeats"](spark, SF).collect()}
    assert got == expected


# --- aligned tokens --------------------------------------------------------------------


def plain_alignment(texts):
    """Measures of each text, token by token."""
    first = load_tokenizer(tokenizer_path(), specials=False)
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def spans(tokens):
        at, out = 0, []
        for number, raw in tokens:
            out.append((number, at, at + len(raw)))
            at += len(raw)
        return out

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        a = [(i, bytes(byte_of[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in second.encode(text)]
        whole = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(None)
            continue
        a, b = spans(a), spans(b)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        counts.update(links)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (*r[:3], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4])
        for r in rows
    ]


SAMPLES = ["", None, " ", "  ", "a", "a ", " a", "a  b", "a\tb\n\nc", "Hello, world's best!", "漢字かな交じり", "é à ü", "▁", "a▁b"]
SAMPLES += ["<|endoftext|> x <s> </s> <unk> <0x41>", "👩‍👩‍👧 🙂", "x" * 300, "1234567 89", "\x00\x01", "ﬁ Ａ é", "a  ", "naïve café " * 50, "a", "a"]


@pytest.mark.parametrize("lookup_pairs", [0, alignment.LOOKUP_PAIRS])
def test_alignment_equals_token_by_token(spark, lookup_pairs):
    schema = "doc_id long, text string, n long, digest string, weight int"
    frame = spark.createDataFrame([(i if i else None, t, 1, "", 2) for i, t in enumerate(SAMPLES)], schema).repartition(3)
    found = alignment.align(frame, tokenizer_path(), MODEL, lookup_pairs)
    got = {r.doc_id or 0: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect()}
    assert [got[i] for i in range(len(SAMPLES))] == plain_alignment(SAMPLES)
    assert alignment.align(frame.limit(0), tokenizer_path(), MODEL, lookup_pairs).collect() == []


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = sorted(docs, key=lambda r: r.doc_id)
    got = {r.doc_id: tuple(r[c] for c in alignment.MEASURES) for r in QUERIES["op13_alignment"](spark, SF).collect()}
    # Token by token is slow: only what does not go through all pairs of a text.
    first, second = load_tokenizer(tokenizer_path(), specials=False), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in docs:
        n_a, n_b = len(first.encode(" " + r.text, add_special_tokens=False).ids), len(second.encode(r.text))
        assert got[r.doc_id][:2] in ((n_a, n_b), (0, 0))
    short = [r for r in docs if len(r.text) < 400]
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string")
    small = {r.doc_id: tuple(r[c] for c in alignment.MEASURES) for r in alignment.align(frame, tokenizer_path(), MODEL).collect()}
    expected = [tuple(x[k] for k in (0, 1, 2, 3, 4, 5, 6)) for x in plain_alignment([r.text for r in short])]
    assert [small[r.doc_id] for r in short] == expected


ENCODER = PieceEncoder(MODEL)
LETTERS = st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "1", "é", "漢", "👩", "▁", "<s>", "the", " the", "'s", "\x00", " ", "́"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=25).map("".join), max_size=5))
def test_pieces_equal_the_library(texts):
    ids, counts = ENCODER.encode(texts)
    cuts = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
    assert [x.tolist() for x in cuts] == [ENCODER.model.encode(t) for t in texts]


def test_model_is_encoded_word_by_word():
    assert ENCODER._by_word


def test_long_texts_are_cut_where_words_start():
    rng = np.random.default_rng(5)
    text = "  ".join("".join(rng.choice(list("abc é漢"), 9)) for _ in range(60_000))
    ids, counts = ENCODER.encode(["x", text, "", text[:300_000] + " "])
    cuts = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in cuts] == [ENCODER.model.encode(t) for t in ("x", text, "", text[:300_000] + " ")]


def test_slices_of_pairs_hold_every_row(monkeypatch):
    monkeypatch.setattr(alignment, "_PENDING_PAIRS", 3)
    lists = [[1], [], [2, 3], [4, 5, 6, 7], [], [8], [9, 10], [11]]
    columns = [pa.array(range(len(lists))), *(pa.array(lists, pa.list_(pa.int32())) for _ in range(3))]
    batch = pa.RecordBatch.from_arrays(columns, ["n", "pairs_a", "pairs_b", "times"])
    slices = list(alignment._sliced([batch, batch.slice(0, 0)], 1))
    assert [x for s in slices for x in s.column(0).to_pylist()] == list(range(len(lists)))
    found = [alignment._lists(s, 1) for s in slices]
    assert [t for _, times, _ in found for t in times.tolist()] == [x for each in lists for x in each]
    assert [n for _, _, sizes in found for n in sizes.tolist()] == [len(each) for each in lists]
    assert all(len(pair) <= 3 or len(sizes) == 1 for pair, _, sizes in found)
