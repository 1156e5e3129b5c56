"""A corpus from raw documents to packed sequences, in five stages.

Each stage is written as Parquet in the shared folder and read again by the next one. All stages but the
last give the columns of documents, in their order; further columns that docs may have, whatever their
names, stay as they are. Rows that repeat a doc_id, or have none, are rows of their own; texts of any
length are read whole; an empty table gives an empty one. What each stage does with null and empty
texts stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelmill.llm import decontam, langid, linededup, neardedup, packing
from labelmill.llm.queries import WORD_TOKENIZER
from labelmill.session import materialize, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or too far from every language's centroids.

    So null and empty texts go. Repeated rows are judged alike. Without a labelled row there is nothing to
    compare with, and all go.
    """
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit_on(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts blocks of lines that an earlier document has; drops documents that are left blank.

    Null and empty texts, and blank ones that lost nothing, stay. A null doc_id loses nothing and is no
    earlier document; rows of one doc_id lose nothing to each other.
    """
    small_batches(spark)
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest doc_id.

    Null and empty texts and null ids stay; rows that repeat the kept doc_id stay too.
    """
    small_batches(spark)
    return neardedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; null and empty items are looked for nowhere. Each row is judged by its own text.
    """
    small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row for each piece, with its place.

    A null or empty text is its end token alone. Repeated rows are packed each.
    """
    small_batches(spark)
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL has no tokenizer and no learned language model, so there is none; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
