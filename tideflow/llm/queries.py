"""The queries of the training-data operators, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm import bpe_automaton, deleted_interpolation, language_id, ngram_jaccard, nn_descent, oracles, packing, quality_classifier, quality_rules, substring_dedup, token_counts


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit_language_model(docs.where(~language_id.held_out()))
    got = language_id.identify_language(docs, model)
    return got.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_classifier.fit_quality_classifier(docs, _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return quality_classifier.classify_quality(docs, model)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), 50256)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents", "doc_id", "text"), n=3, percent=90)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"), texts=False).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    field = quality_rules.fit_line_field(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.apply_quality_rules(docs, field)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_deleted_interpolation, op2_nn_descent, op3_language_id, op4_bpe_automaton, op5_quality_classifier, op6_packing, op7_token_counts, op8_ngram_jaccard, op9_substring_dedup, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op8_ngram_jaccard": oracles.NGRAM_JACCARD, "op9_substring_dedup": oracles.SUBSTRING_DEDUP}
