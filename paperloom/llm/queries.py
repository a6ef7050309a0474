"""The queries of this subpackage, with the parameters used in production, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import token_shards
from .chat import format_pairs, neighbour_pairs
from .common import new_path, table
from .decontaminate import leaks
from .fill_in_middle import digests
from .fingerprints import edited_pairs
from .hard_negatives import hard_negatives
from .language_id import identify
from .near_dups import classes
from .oracle import ORACLE_SQL
from .packing import pack_documents
from .repeats import deduplicated
from .secrets import scan
from .token_counts import token_counts
from .warc import round_trip

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 2048


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(neighbour_pairs(table(spark, sf_dir, "conversations")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), MAX_TOKENS)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(table(spark, sf_dir, "documents"), new_path(spark, "shards"), public_tokenizers.path(TOKENIZER))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_preference_formatting": op1_preference_formatting,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_language_id": op3_language_id,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scans": op6_secret_scans,
    "op7_bagminhash_near_dedup": op7_bagminhash_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_wavelet_token_shards": op12_wavelet_token_shards,
    "op13_fill_in_middle": op13_fill_in_middle,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
