"""From raw documents to packed sequences, in five stages.

Each stage gets what the one before it kept, as a table in the shared folder, so a lost executor costs at most one stage's tasks.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, language_id, near_dups, packing, secrets
from paperloom.llm.common import table, written
from paperloom.llm.queries import MAX_TOKENS, TOKENIZER

#: A text, of any length, is in no learned language if its cosine with all is below this. Texts that share no trigram with a language
#: have cosines around 0 with a deviation of 1 / sqrt(1024) = 0.031, so 98 % of them are below 0.08 with four languages.
LEAST_SCORE = 0.08


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, null ones with them, and texts that resemble no language learned from the labelled rows; repeated
    rows and rows without a doc_id are judged like others, and an empty table stays empty."""
    return language_id.recognised(docs, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts stays: the least doc_id, then the least digest; rows without a doc_id come last
    in a class but stay where they are its only ones. Null and empty texts are one class; an empty table stays empty."""
    return near_dups.without_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go; null and empty texts hold none, and repeated rows go or stay
    together. Without documents or items nothing goes."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark, overlapping ones by one; n_chars follows the text. Null texts stay null, with a null
    n_chars; no row goes."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences; a null or empty text is a piece of one id, repeated rows are packed each, and
    an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), MAX_TOKENS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Language profiles, signatures, edit distances and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
