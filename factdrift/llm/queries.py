"""One query per operator of this package, over whole tables, and the SQL some have to equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factdrift.llm import (
    alignment,
    bpe_chunks,
    chat,
    minhash,
    packing,
    pii,
    quality,
    repeats,
    secrets,
    simhash,
    token_counts,
    vector_codes,
    vectors,
)
from factdrift.llm.common import table
from factdrift.llm.oracles import ORACLES as ORACLES
from factdrift.llm.spans import digest_columns

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PACK_END = 1
END_OF_TEXT = 50256


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *digest_columns(spans, pii.base_only(spans), pii.KINDS))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, whose rows are records of one turn, and one record of two turns."""
    words = r"\### Assistant: </turn> ok"
    pair = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("position"),
        F.to_json(F.struct(F.lit(words).alias("prompt"), F.lit(words).alias("response"))).alias("record"),
    )
    records = chat.as_records(table(spark, sf_dir, "conversations")).unionByName(pair)
    return chat.digest_conversations(chat.format_turns(chat.canonical_turns(records)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(secrets.BASE_KINDS))
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *digest_columns(spans, base, secrets.BASE_KINDS)
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), PACK_END)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat streams written from the documents."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_TEXT)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash.group(table(spark, sf_dir, "documents")).select("doc_id", fingerprint, "component_id")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.group(table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.compare_with_next(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"),
    )


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_chat": op2_chat,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_vectors": op9_vectors,
    "op10_minhash": op10_minhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_repeats": op12_repeats,
    "op13_alignment": op13_alignment,
}
