"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from receivables.llm import (
    binary_index, encoding, language, near_dedup, packing, part_codes, personal_data, perspectives, pivot_index, ranked_search, substring_dedup,
    url_filter, warc_bundles,
)
from receivables.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_index.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True).drop("row_key")


def op5_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_rows(table(spark, sf_dir, "documents")).drop("row_key")


def op6_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_rows(table(spark, sf_dir, "documents"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_pivot_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.exact_top(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op11_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archived_pages(table(spark, sf_dir, "pages"))


def op12_laesa_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_rmq_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op7_perspective_rotation": perspectives.ORACLE, "op10_pivot_distance_topk": pivot_index.ORACLE, "op11_seekable_warc": warc_bundles.ORACLE,
        "op12_laesa_part_codes": part_codes.oracle(), "op13_rmq_ranked_search": ranked_search.ORACLE,
    }
