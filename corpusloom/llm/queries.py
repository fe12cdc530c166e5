"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontaminate, language_id, line_dedup, mixing, ngram_join, pii, quality_rules, token_counts, token_shards, vector_codes
from .common import shared_dir, table

#: Files of the public tokenizers that the queries use.
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_jaccard_join(documents, ngram_join.Measure(width=3, part=90))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    turn = F.col("id")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    nodes = chat.reply_nodes(rows.unionByName(more).withColumn("text", F.coalesce("text", F.lit(""))))
    return chat.chat_digest(chat.read_template(chat.format_chats(nodes)))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    token_shards.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, path)
    return token_shards.documents(token_shards.read_shards(spark, path))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)
    counted = counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_counts.n_tokens(F.col("prefix_counts")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(documents.where(~held_out), PIECES)
    return language_id.identify(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", "n_chunks_removed", "n_chars_removed")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")))
    summed = vector_codes.label_errors(coded)
    return summed.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.codebook_digest(codebooks)).alias("codebooks_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, PIECES)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.link_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE, decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_ngram_jaccard, op3_decontamination, op4_chat_formatting, op5_token_shards,
        op6_quality_rules, op7_token_counts, op8_language_id, op9_line_dedup, op10_personal_data, op11_vector_codes, op12_alignment, op13_bpe,
    )
}
