"""Bucketed tables join without a shuffle; the id search equals a scan and reads fewer files."""

import uuid

import pytest
from pyspark.sql import functions as F

from receivables.operators import features, quality
from receivables.sources import layout


@pytest.fixture()
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_and_group_without_an_exchange(spark, scratch, no_broadcast):
    inv = spark.range(400).select(F.concat(F.lit("I"), "id").alias("invoice_id"), F.lit("C").alias("customer_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") % 50).alias("due_date"), F.col("id").cast("double").alias("invoice_amount"))
    pay = spark.range(900).select(F.concat(F.lit("P"), "id").alias("payment_id"), F.concat(F.lit("I"), F.col("id") % 450).alias("invoice_id"), F.lit("2024-02-01").cast("date").alias("payment_date"), F.col("id").cast("double").alias("amount"))
    name = uuid.uuid4().hex
    b_inv, b_pay = (layout.save_bucketed(df, f"{t}_{name}", "invoice_id", 8, f"{scratch}/{t}") for df, t in ((inv, "inv"), (pay, "pay")))
    for op in (lambda i, p: features.late_target(i, p, 7), lambda i, p: quality.overpayments(p, i), lambda i, p: p.groupBy("invoice_id").count()):
        assert "Exchange" in plan(op(inv, pay)) and "Exchange" not in plan(op(b_inv, b_pay))
        assert sorted(map(str, op(b_inv, b_pay).collect())) == sorted(map(str, op(inv, pay).collect()))


IDS = ["Alpha-1", "ALPHA-2", "beta", "ab", "a", "", None, "alphabet", "xxalphaxx", "lphA", "äÖü-9", "%_%", "a%b_c"] + [f"cust-{i:05d}" for i in range(300)]


@pytest.mark.parametrize("term", ["", "a", "AB", "alpha", "lpha-2", "cust", "cust-00017", "00", "zzz", "%_", "Öü", "alphalpha", "b_c"])
def test_search_equals_a_scan(spark, searchable, term):
    rows, folder = searchable
    want = [r for r in rows.collect() if not term or r.customer_id is not None and term.lower() in r.customer_id.lower()]
    got = layout.search(spark, folder, rows.schema, term)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and got.columns == rows.columns


def test_search_reads_fewer_files(spark, searchable):
    rows, folder = searchable
    every = len(layout.search(spark, folder, rows.schema, "").inputFiles())
    assert every > 30
    for term, most in (("cust-00017", 4), ("zzz", 0), ("alpha", 16)):
        parts = {r.part for r in layout.matching_ids(spark, folder, term).collect()}
        read = layout.search(spark, folder, rows.schema, term)
        scans = [line for line in plan(read).split("\n") if "PartitionFilters" in line]
        assert len(parts) <= most and all("__part" in line for line in scans)
    lists = layout.matching_ids(spark, folder, "cust-00017")
    assert "gram_part" in plan(lists).split("PartitionFilters")[1][:80] and "Python" not in plan(lists)


@pytest.fixture(scope="module")
def searchable(spark, tmp_path_factory):
    rows = spark.createDataFrame([(f"I{n}", i) for n, i in enumerate(IDS * 2)], "invoice_id string, customer_id string")
    folder = f"{tmp_path_factory.mktemp('search')}/t"
    layout.save_searchable(rows, folder)
    return rows, folder
