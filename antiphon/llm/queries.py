"""The queries of this folder, for __spark_entry__.py: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from antiphon.llm import decontamination, fingerprints, importance, lexical, packing, pii, quality_rules, simhash, substring_dedup, token_files, url_rules, vector_codes, warc
from antiphon.llm._common import read_table
from antiphon.llm.sql import ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents")).drop("factors", "n_factors")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(read_table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("version")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_with_errors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = (op1_quality_rules, op2_best_fit_packing, op3_decontamination, op4_token_files, op5_substring_dedup, op6_simhash, op7_url_rules, op8_pii, op9_importance, op10_warc, op11_lexical_search, op12_fingerprints, op13_vector_codes)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
