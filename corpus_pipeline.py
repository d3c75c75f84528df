"""From raw documents to token files in five stages, each over all that the stage before it kept.

Every stage is called with (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. ORACLE_SQL is None: the cube method's sample, the LSH forest's
classes and the tokenizer's ids have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontam, jaccard, mixture, quality, tokens
from parlance.llm.common import new_folder, small_batches
from parlance.llm.queries import table, word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    small_batches(spark)
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    small_batches(spark)
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    small_batches(spark)
    return mixture.taken_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, read back: doc_id, start, n_tokens, ids_crc32 for each document written."""
    small_batches(spark)
    return tokens.read_token_files(tokens.write_token_files(docs, word_bpe(), end_id=1, memory=tokens.SMALL))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
