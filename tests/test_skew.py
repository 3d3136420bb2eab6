"""A customer holding a third of all invoices: results are unchanged and its rows are spread over many tasks."""

import datetime as dt

from pyspark.sql import functions as F

from receivables.functions.joins import hot_keys, lookup_join
from receivables.operators import features, metrics, scoring

AS_OF = dt.date(2001, 6, 30)
INV = ("invoice_id string, customer_id string, issue_date date, due_date date, invoice_amount double, currency string, "
       "status string, invoice_type string, channel string")
CUST = "customer_id string, name string, payment_terms_days int, credit_limit double"


def data(spark):
    rows = []
    for k in range(3000):
        cust = "HOT" if k % 3 == 0 else f"C{k % 97:03d}"
        issue = dt.date(2001, 1, 1) + dt.timedelta(days=k % 150)
        rows.append((f"I{k:05d}", cust, issue, issue + dt.timedelta(days=30), 100.0 + (k * 37) % 5000, "USD",
                     "open" if k % 4 else "paid", "one_time", "online"))
    inv = spark.createDataFrame(rows, INV).repartition(8)
    cust = spark.createDataFrame([("HOT", "Hot Co", 30, 50000.0)] + [(f"C{j:03d}", f"Co {j}", 45, 20000.0) for j in range(97)], CUST)
    return inv, cust


def test_hot_key_detection_is_bounded(spark):
    inv, _ = data(spark)
    counts = inv.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    assert [r.customer_id for r in hot_keys(counts, "customer_id", "n", hot_share=0.05, rows_per_task=100).collect()] == ["HOT"]


def test_lookup_join_equals_plain_join_and_spreads_hot_key(spark):
    inv, cust = data(spark)
    plain = sorted(map(tuple, inv.join(cust, "customer_id", "left").collect()))
    salted = lookup_join(inv, cust, "customer_id", "left", spread="invoice_id", hot_share=0.05, rows_per_task=64)
    assert sorted(map(tuple, salted.select(*inv.join(cust, "customer_id", "left").columns).collect())) == plain
    # The hot customer's 1000 invoices land in many shuffle partitions, not one (coalescing off so the join's
    # own partitions are visible on this tiny input).
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = salted.where("customer_id = 'HOT'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert parts > 1


def test_operators_unchanged_with_hot_customer(spark):
    inv, cust = data(spark)
    scores = scoring.rule_risk_scores(inv, cust, AS_OF)
    plain_totals = inv.groupBy("customer_id").agg(F.sum("invoice_amount").alias("t"))
    assert scores.count() == inv.where("status = 'open'").count()
    assert metrics.customer_risk(inv, cust).count() == 98
    f = features.engineer_features(inv, cust, None, AS_OF)
    assert f.count() == 3000 and f.where("customer_id = 'HOT'").count() == 1000
    assert plain_totals.count() == 98


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(
    keys=st.lists(st.sampled_from(["a", "b", "c", "d", None]), min_size=1, max_size=80),
    how=st.sampled_from(["left", "inner"]),
    share=st.sampled_from([0.0, 0.1, 0.5, 1.0]),
)
def test_lookup_join_matches_plain_join(spark, keys, how, share):
    fact = spark.createDataFrame([(f"r{i}", k) for i, k in enumerate(keys)], "rid string, k string")
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    plain = sorted(map(tuple, fact.join(dim, "k", how).select("rid", "k", "v").collect()), key=repr)
    salted = lookup_join(fact, dim, "k", how, spread="rid", hot_share=share, rows_per_task=4)
    assert sorted(map(tuple, salted.select("rid", "k", "v").collect()), key=repr) == plain


def test_no_partition_holds_a_hot_or_null_key(spark):
    """Half of the rows without a key, a third with one key: the join's partitions stay near their fair share."""
    n, parts = 8000, 64
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("rid"),
        F.when(F.col("id") % 2 == 0, F.lit(None).cast("string")).when(F.col("id") % 6 < 4, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
    )
    dim = rows.select("k").where("k is not null").distinct().withColumn("v", F.length("k"))
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts), "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        joined = lookup_join(rows, dim, "k", "left", spread="rid", rows_per_task=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = sorted(map(tuple, rows.join(dim, "k", "left").select("rid", "k", "v").collect()), key=str)
        assert sorted(map(tuple, joined.select("rid", "k", "v").collect()), key=str) == plain
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) <= 4 * n / parts


def test_an_invoice_hot_by_loose_outcomes_is_salted(spark, monkeypatch):
    """Few actions, but a third of all outcomes on one invoice and without an action: they fill many partitions."""
    import datetime as dt

    from receivables.functions import joins
    from receivables.operators import audit

    t = dt.datetime(2024, 1, 1)
    actions = spark.createDataFrame([(f"A{i}", f"I{i}", "C", "call", t, "phone", "me", None) for i in range(40)],
                                    "action_id string, invoice_id string, customer_id string, action_type string, action_date timestamp_ntz, channel string, sent_by string, notes string")
    responses = spark.createDataFrame([("R", "A1", t, "email", True)], "response_id string, action_id string, response_date timestamp_ntz, response_type string, payment_promised boolean")
    outcomes = spark.range(3000).select(
        F.col("id").cast("string").alias("outcome_id"), F.when(F.col("id") < 1000, F.lit("I1")).otherwise(F.concat(F.lit("J"), "id")).alias("invoice_id"),
        F.lit(None).cast("string").alias("action_id"), F.lit("paid").alias("outcome_type"), F.lit(t).cast("timestamp_ntz").alias("outcome_date"),
        F.col("id").cast("double").alias("amount_collected"), F.lit(1).alias("days_to_payment"))
    want = sorted(map(str, audit.invoice_history(actions, responses, outcomes).collect()))
    seen = []

    def salted(fact, dim, key, how, **more):
        out = joins.lookup_join(fact, dim, key, how, **more, rows_per_task=50)
        seen.append(max(r["count"] for r in out.where("invoice_id = 'I1'").groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(audit, "lookup_join", salted)
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert sorted(map(str, audit.invoice_history(actions, responses, outcomes).collect())) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen[0] < 400
