"""Corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result as Parquet into the shared checkpoint folder and reads it
back, so a lost executor never costs more than the current stage.

Defined results: documents without a letter go in the first stage, and no others (without a
labelled training row ``lang`` stays as it is); of a group of near-duplicates the smallest doc_id stays;
texts that lose words or have spans masked get a new ``n_chars``; documents that lose all words stay, empty. Null ids,
empty tables and repeated rows are handled as each operator's module says; other columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.llm import language, near_dedup, packing, personal_data, registry, substring_dedup
from receivables.llm.common import table, written


def recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a missing ``lang`` is filled in where there are labels to learn from."""
    judged = language.identify(docs, "__lang_pred", "__score", "__letter").where("__letter")
    known = F.when(F.col("__lang_pred") != language.UNKNOWN, F.col("__lang_pred"))
    return judged.withColumn("lang", F.coalesce("lang", known)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.one_of_each(docs, near_dedup.CORPUS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows."""
    return recounted(substring_dedup.without_repeats(docs))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind."""
    return recounted(personal_data.masked_texts(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, registry.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data_masked),
    ("packing", packed),
]

# Signatures, models and the tokeniser are beyond SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
