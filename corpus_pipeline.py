"""Corpus pipeline: five stages over `documents`, each calling one operator of tideflow.llm on all that the stage before kept.

language ID (rejects texts without a language it is sure of) -> quality classifier (rejects low and toxic grades) ->
n-gram Jaccard join (one document of each group stays: the one of the least doc_id) -> substring dedup (cuts repeated
passages out of the texts) -> best-fit packing (token pieces placed in sequences).

Defined results, for every stage: a row is a document by itself, whether its doc_id is null or stands in other rows
too; columns beside those of the operators are passed on, whatever their names. A null or empty text has no language and
goes at the first stage; given to the later stages it is kept. An empty table, and empty labels, give what the operators
say: no rows, and a classifier that knows no grade and selects nothing below its threshold's share. Of documents in one
group the least doc_id stays, one without an id only where no other has one; of rows that repeat id and text one stays.
Passages are judged in the order of doc_id, rows without one last, repeated ids in the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tideflow.operators as op
from tideflow.flow import flow
from tideflow.llm import language_id, ngram_jaccard, packing, quality_classifier, substring_dedup
from tideflow.llm.common import discard, materialise
from tideflow.llm.queries import tokenizer_path

#: A language is accepted from this score on.
LEAST_LANGUAGE_SCORE = 0.5


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column has."""
    taken = {c.lower() for c in docs.columns}
    return tuple(n if n not in taken else next(x for k in range(len(taken) + 1) if (x := f"{n}_{k}") not in taken) for n in names)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows and a column that tells them apart, ordered as doc_id: doc_id itself, or where ids repeat or are null the row's place in their order, rows without an id last."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    at, place, none = _free(docs, "row_at", "row_place", "row_unnamed")
    rows = materialise(docs.withColumn(at, F.monotonically_increasing_id()))
    order = rows.select(at, "doc_id", F.col("doc_id").isNull().alias(none))
    places = op.with_index(flow(order, none, "doc_id", at), name=place).df.select(at, place)
    return materialise(rows.join(places, at).drop(at)), place


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = _free(docs, "lang_pred", "lang_score")
    found = language_id.with_language(docs, language_id.fit_language_model(docs), names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = _free(docs, "expected_grade", "tail_probability", "selected")
    model = quality_classifier.fit_quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.with_quality(docs, model, names=names).where(F.col(names[2])).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group; of rows that repeat both id and text one goes on, with or without words."""
    rows, key = _keyed(docs)
    if key != "doc_id":
        rows, key = _keyed(docs.dropDuplicates(["doc_id", "text"]))
    found = ngram_jaccard.jaccard_components(rows, n=5, percent=80, key=key)
    return rows.join(found.where(F.col(key) == F.col("component_id")).select(key), key, "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a document of which nothing is left goes. n_chars, if there, follows the text."""
    rows, key = _keyed(docs)
    cut_text, gone = _free(rows, "cut_text", "cut_words")
    cut = substring_dedup.remove_repeats(rows, key=key).where("n_removed < n_words or n_words = 0").select(key, F.col("text").alias(cut_text), F.col("n_removed").alias(gone))
    rest = rows.join(cut, key)
    changed = {"text": F.when(F.col(gone) > 0, F.col(cut_text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(gone) > 0, F.length(cut_text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rest.withColumns(changed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the near-duplicate one can be put in SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
