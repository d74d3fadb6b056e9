"""One registered query per operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, language, lines, mixing, packing, pages, repair, scoring, simhash, tokens, vectors, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(parts: int):
    """Whether a document is held out of training: its id's CRC-32 modulo ``parts`` is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 0, F.lit(False))


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, folder, "documents"))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_copied_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_dedup.*")


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_documents(table(spark, folder, "documents"), held_out(10))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(5))
    found = language.identify(docs, docs.where(~F.col("held_out")))
    return found.select("doc_id", "held_out", "language.*")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"))


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    text = pages.extract(F.col("html"))
    return table(spark, folder, "pages").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, folder, "conversations")), present="present")


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode_documents(table(spark, folder, "documents"), ranks, pattern, decoded=True)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / bpe.WIDE).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_best_fit_packing, op3_line_dedup, op4_lm_scoring, op5_language_id, op6_token_counts,
        op7_embedding_dedup, op8_simhash, op9_html_extraction, op10_mixing, op11_conversation_repair, op12_byte_bpe,
        op13_whitening,
    )
}

SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
