"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from factdrift.llm import bpe_chunks, chat, minhash, packing, pii, quality, secrets, simhash, token_counts, vectors
from factdrift.llm.queries import END_OF_TEXT, tokenizer_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word 4952935900253052 token = 'abcdefgh12' bob.smith@x.com " * 3000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, None, "a", 1),
    (4, "same text here", "en", None, None),
    (4, "same text here", "en", None, None),
    (None, "no id 1.2.3.4", "en", "a", 3),
    (5, "é\U0001f600 <|endoftext|> \n\n  x", "en", "a", 3),
]
CLASHING = ["score", "fp", "spans", "component_id", "h", "part", "k", "ids", "merge", "seen", "base"]


def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def run_all(spark, docs):
    path = tokenizer_path()
    return {
        "pii": pii.find_pii(docs),
        "redact": pii.redact(docs),
        "secrets": secrets.scan_secrets(docs),
        "pack": packing.pack(docs, path, 1),
        "counts": token_counts.document_token_counts(docs, path, END_OF_TEXT),
        "quality": quality.score_documents(docs, labels(spark)),
        "good": quality.keep_good(docs, labels(spark)),
        "encode": bpe_chunks.encode_documents(docs, path),
        "digest": bpe_chunks.digest_documents(docs, path),
        "group": simhash.group(docs),
        "one": simhash.keep_one(docs),
        "next": minhash.compare_with_next(docs),
        "prints": minhash.fingerprint_documents(docs),
    }


def test_rows_stay(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    wide = docs.select("*", *(F.lit(7).alias(c) for c in CLASHING))
    for name, result in run_all(spark, wide).items():
        rows = result.collect()
        if name == "pack":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None}
            assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
        elif name == "one":
            assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 4, 5] and result.columns == wide.columns
        elif name == "good":
            assert result.columns == wide.columns
        else:
            assert len(rows) == len(ROWS), name


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, result in run_all(spark, docs).items():
        assert result.count() == 0, name


def test_vectors(spark):
    near = [1.0, 0.01, 0.0]
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, near, 1), (4, near, 1), (5, near, 2), (6, near, None),
        (7, [0.0, 0.0, 0.0], 1), (8, None, 1), (9, [1.0, None, 0.0], 1), (10, [float("nan"), 1.0, 0.0], 1),
        (11, [float("inf"), 1.0, 0.0], 1), (12, [], 1), (13, [1.0, 0.0], 1), (14, [1e-30, 0.0, 0.0], 1), (5, near, 2), (None, near, 3),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.group(frame).collect()}
    assert {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), (14, 4, 1, False)} <= found
    assert (5, 1, 5, True) in found and (6, 0, 6, True) in found and (13, 0, 13, True) in found
    assert all((i, 0, i, True) in found for i in (7, 8, 9, 10, 11, 12))
    assert vectors.group(frame.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "tie"), (1, 1, None, "x"), (None, None, "assistant", "<|end|>\\"), (2, 5, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(3))
    found = {r.conv_id: r for r in chat.digest_conversations(chat.format_turns(chat.canonical_turns(chat.as_records(frame)))).collect()}
    assert found[1].n_turns == 3 and found[None].loss_chars == 8 and found[2].loss_chars == 0
    assert chat.digest_conversations(chat.format_turns(chat.canonical_turns(chat.as_records(frame.limit(0))))).count() == 0


@pytest.mark.parametrize("record", [None, "no json", '{"strange": 1}', "[1]"])
def test_unmapped_records_are_told(spark, record):
    frame = spark.createDataFrame([(1, 0, record)], "conv_id long, position long, record string")
    row = chat.canonical_turns(frame).first()
    assert row.role is None and row.text == record
