"""Queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill import session
from labelmill.llm import chat, decontam, divergence, interaction, langid, linededup, mainhtml, media, neardedup, packing, substrings, toxicity, warc
from labelmill.llm.oracles import SQL  # noqa: F401
from labelmill.session import materialize

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; texts then go to Python in small batches."""
    session.small_batches(spark)
    return session.table(spark, sf_dir, name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_column(table(spark, sf_dir, "documents"))).drop("error")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _fold(of: str, folds: int):
    """CRC-32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % folds


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit_on(docs.where(~held_out))
    return langid.identify(docs, model, held_out).select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = linededup.dedup_lines(docs, drop_emptied=False)
    return kept.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "n_chars")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.conversation_digests(chat.format_conversations(turns, BYTE_TOKENIZER), in_order=True).drop("n_tokens", "loss_tokens")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    learnt = table(spark, sf_dir, "labels").where(F.coalesce(_fold("doc_id", 5) != 0, F.lit(False)))
    return toxicity.toxicity(docs, toxicity.fit_on(docs, learnt), held_out)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_warc": op3_warc,
    "op4_media_columns": op4_media_columns,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_interaction": op12_filter_interaction,
    "op13_main_text": op13_main_text,
}
