"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.sql import ORACLES  # noqa: F401  # the others learn models, run tokenizers or hash as SQL can't; tests hold them against brute force


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.gridorder import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import identify

    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import quality

    return quality(table(spark, sf_dir, "documents", "doc_id", "text")).drop("posterior")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import toxic_scores

    return toxic_scores(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat import chat_digests

    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_digests(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(added))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_chat_format": op5_chat_format,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_source_mixing": op9_source_mixing,
    "op10_sentencepiece": op10_sentencepiece,
}
