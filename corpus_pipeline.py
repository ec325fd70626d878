"""The corpus pipeline: documents in, packed pieces out, each stage on all that the one before it kept.

Part of subpackage llm. Quality classifier (importance resampling), near-duplicate removal (SimHash), benchmark
decontamination, masking of personal data, best-fit packing. SQL can't express the stages, so each is tested against a plain
version (tests/llm): weights, shares and draws by dense sums; links of all pairs of texts; alignment of every document with
every item; spans one candidate after the other; the tokenizer's own ids and best fit on rows.

All stages but the last keep every column, whatever its name. Null and empty texts go through each (near-duplicate removal
keeps one of them); an empty table comes out empty. What each stage does with ties, repeated rows and rows without a doc_id is
said in its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antiphon.llm import _common, decontamination, importance, near_duplicates, packing, pii
from antiphon.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the draw leaves out go. Equal rows share their fate; empty texts stay; without labels all stay."""
    return importance.kept_documents(docs, _common.read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (null last), of equal ids that with the smaller digest of its text; of rows equal in both, one."""
    return near_duplicates.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Texts are judged each for itself, also those of one doc_id; empty ones stay."""
    return decontamination.clean_documents(docs, _common.read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, repeated ones as well, with personal data masked; a null text stays null."""
    return pii.masked_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places; a null or empty text is its end id alone, and repeated rows are packed each for itself."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = _common.keep(out, f"stage-{name}")
            _common.forget(docs)  # a stage's documents, once the next one's are written
        docs = out
    return docs
