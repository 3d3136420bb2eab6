"""The corpus pipeline against a brute-force version of its stages."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from receivables.llm import personal_data
from receivables.llm.common import written

from .conftest import SF
from .test_near_dedup import kept_at_five_words
from .test_packing import check_rows
from .test_substring_dedup import brute as window_brute


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "12 34 !!", None, "s", 8), (90_002, None, "en", "s", 0), (90_003, "mail bob@example.com today", None, "s", 26)], docs.schema)
    docs = written(docs.unionByName(extra), "test")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = written(corpus_pipeline.language_id(spark, docs, SF), "test")
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(before) - set(rows) == {90_001, 90_002} and rows[90_003].lang is not None
    assert all(rows[k].text == before[k].text for k in rows)

    single = written(corpus_pipeline.near_duplicates(spark, kept, SF), "test")
    texts = [(k, r.text) for k, r in rows.items()]
    assert sorted(r.doc_id for r in single.collect()) == kept_at_five_words(texts)

    rows = {r.doc_id: r for r in single.collect()}
    cut = written(corpus_pipeline.repeated_passages(spark, single, SF), "test")
    want = {d: t for d, _, n, t in map(eval, window_brute([(k, r.text) for k, r in rows.items()], 35)) if n}
    assert cut.columns == columns
    assert all(r.text == want.get(r.doc_id, rows[r.doc_id].text) and r.n_chars == len(r.text) for r in cut.collect())

    masked = written(corpus_pipeline.personal_data_masked(spark, cut, SF), "test")
    assert masked.columns == columns and masked.count() == cut.count()
    for r in masked.collect():
        spans = personal_data.base_spans(r.text)
        assert not any(spans.values()), r.doc_id
    assert next(r.text for r in masked.collect() if r.doc_id == 90_003) == "mail [EMAIL] today"

    final = corpus_pipeline.packed(spark, masked, SF).collect()
    check_rows(final, [(r.doc_id, r.text) for r in masked.collect()], 2048)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) > 0
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean = [r for r in rows if r.piece == 0 and not any(personal_data.base_spans(docs[r.doc_id]).values())]
    same = 0
    for r in clean:
        ids = [*tok.encode(docs[r.doc_id], add_special_tokens=False).ids, 0]
        same += r.ids_crc32 == zlib.crc32(np.array(ids[: r.length], "<u4").tobytes())
    assert same > len(clean) / 2  # most documents pass unchanged


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF), "test")
        assert empty.count() == 0


def test_documents_stay_without_labels(spark):
    """No labels at all, and labels on held-out ids only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    extra = spark.createDataFrame([(90_001, "12 34 !!", None, "s", 8), (90_002, None, None, "s", 0), (90_004, "12 34 !!", "en", "s", 8)], docs.schema)
    docs = written(docs.unionByName(extra), "test")
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert len(lettered) > 150
    held = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("en")))
    for table in (docs.withColumn("lang", F.lit(None).cast("string")), held):
        lang = {r.doc_id: r.lang for r in table.collect()}
        got = corpus_pipeline.language_id(spark, table, SF)
        assert got.columns == docs.columns
        assert {r.doc_id: r.lang for r in got.collect()} == {k: lang[k] for k in lettered}
