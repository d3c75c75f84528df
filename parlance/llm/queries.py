"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import audit, chat, decontam, jaccard, licenses, lm, mixture, oracle, quality, secrets, shards, substring, tokens, trie
from parlance.llm.common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.digest(table(spark, sf_dir, "documents"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), word_bpe())


def op4_benchmark_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digest(turns.unionByName(extra))


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_files(tokens.write_token_files(table(spark, sf_dir, "documents"), word_bpe(), end_id=1))


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_secret_layers that SQL can express: how many base spans of each kind a text has."""
    return secrets.digest(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (op1_secret_layers, op2_source_mixing, op3_attention_lm, op4_benchmark_simhash, op5_jaccard_forest, op6_line_quality, op7_repeated_passages, op8_chat_template, op9_token_frames, op10_license_sentences, op11_conversation_trie, op12_filter_audit, op13_exact_shards, secret_counts)}
ORACLE: dict[str, str] = {"op4_benchmark_simhash": oracle.DECONTAMINATION, "op5_jaccard_forest": oracle.NEAR_DUPLICATES, "op6_line_quality": oracle.QUALITY, "op7_repeated_passages": oracle.REPEATED_PASSAGES, "op8_chat_template": oracle.CHAT, "op11_conversation_trie": oracle.TRIE, "op12_filter_audit": oracle.FILTER_AUDIT, "secret_counts": oracle.SECRET_COUNTS}
