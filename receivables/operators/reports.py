"""Dashboard report queries (DB-*, FN-3, FN-11, FN-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import metrics


def _open(invoices: DataFrame) -> DataFrame:
    return invoices.where(F.col("status") == "open")


def dash_kpis(invoices: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    """DB-1 + DB-4: headline KPIs and the KPI table in one row (raw numbers and display text)."""
    a = E.as_of_lit(as_of)
    is_open = F.col("status") == "open"
    dec = F.col("invoice_amount").cast("decimal(18,2)")
    head = invoices.agg(
        F.sum(F.when(is_open, dec)).alias("ar"),
        F.sum(F.when(is_open & (F.col("due_date") < a), dec)).alias("od"),
        F.count_if(F.col("status") == "paid").alias("paid_n"),
        F.count(F.lit(1)).alias("all_n"),
        F.count_if(is_open).alias("open_invoices"),
        F.avg(F.when(is_open, E.days_late(a, "due_date"))).alias("avg_od_days"),
    )
    n_cust = customers.agg(F.count(F.lit(1)).alias("total_customers"))
    total_ar = F.coalesce(F.col("ar"), F.lit(0)).cast("double")
    overdue_ar = F.coalesce(F.col("od"), F.lit(0)).cast("double")
    avg_open = F.try_divide(total_ar, F.col("open_invoices"))
    return head.crossJoin(n_cust).crossJoin(metrics.dso_anchored(invoices)).select(
        total_ar.alias("total_ar"),
        E.compact_currency(total_ar).alias("total_ar_text"),
        overdue_ar.alias("overdue_ar"),
        E.compact_currency(overdue_ar).alias("overdue_ar_text"),
        F.when(total_ar > 0, E.round_dec(overdue_ar / total_ar * 100, 2)).otherwise(0.0).alias("overdue_pct"),
        E.round_dec("dso", 2).alias("dso"),
        F.coalesce(E.pct("paid_n", "all_n"), F.lit(0.0)).alias("collection_rate"),
        "open_invoices",
        E.money2(avg_open).alias("avg_open_invoice"),
        E.compact_currency(E.money2(avg_open)).alias("avg_open_invoice_text"),
        "total_customers",
        E.round_dec("avg_od_days", 2).alias("avg_days_overdue"),
    )


def dash_aging(invoices: DataFrame, as_of) -> DataFrame:
    """DB-2: five-bucket aging of open AR with amount, count and share."""
    aged = _open(invoices).withColumn("aging_bucket", E.dash_aging_bucket(E.days_overdue("due_date", as_of)))
    g = aged.groupBy("aging_bucket").agg(
        E.money_sum("invoice_amount").alias("amount"), F.count("invoice_id").alias("invoice_count")
    )
    # <= 5 aggregated rows: the unpartitioned window is a single tiny task.
    total = F.sum(F.col("amount").cast("decimal(28,2)")).over(Window.partitionBy()).cast("double")
    order = F.array_position(F.array(*[F.lit(b) for b in E.DASH_BUCKETS]), F.col("aging_bucket"))
    return g.withColumn("percentage", E.pct("amount", total)).orderBy(order)


def monthly_payments(payments: DataFrame) -> DataFrame:
    """DB-3: payments collected per calendar month; like all groups here, none for a NULL key."""
    return (
        payments.where(F.col("payment_date").isNotNull())
        .groupBy(F.trunc("payment_date", "MM").alias("month"))
        .agg(E.money_sum("amount").alias("amount"))
        .orderBy("month")
    )


def top_customers_ar(invoices: DataFrame, n: int = 10) -> DataFrame:
    """DB-5: the ``n`` customers with the most open AR (ties by customer_id)."""
    return (
        _open(invoices)
        .where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(E.money_sum("invoice_amount").alias("outstanding_ar"))
        .orderBy(F.desc("outstanding_ar"), "customer_id")
        .limit(n)
    )


def status_distribution(invoices: DataFrame) -> DataFrame:
    """DB-6: invoice count per status."""
    return invoices.where(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("invoice_count")).orderBy(F.desc("invoice_count"))


def customer_summary(invoices: DataFrame, n: int = 50) -> DataFrame:
    """DB-7: per-customer count, total, mean, max and open AR (0 default); top ``n`` by total."""
    dec = F.col("invoice_amount").cast("decimal(18,2)")
    g = invoices.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("invoice_id").alias("total_invoices"),
        F.sum(dec).alias("tot"),
        F.count("invoice_amount").alias("n_amt"),
        F.max("invoice_amount").alias("max_invoice"),
        F.sum(F.when(F.col("status") == "open", dec)).alias("open_dec"),
    )
    return g.select(
        "customer_id", "total_invoices",
        F.col("tot").cast("double").alias("total_amount"),
        E.money2(F.col("tot").cast("double") / F.col("n_amt")).alias("avg_invoice"),
        "max_invoice",
        F.coalesce(F.col("open_dec"), F.lit(0)).cast("double").alias("open_ar"),
    ).orderBy(F.desc("total_amount"), "customer_id").limit(n)


def invoice_timeline(invoices: DataFrame) -> DataFrame:
    """DB-8: invoice volume and value per issue month."""
    return (
        invoices.where(F.col("issue_date").isNotNull())
        .groupBy(F.trunc("issue_date", "MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("invoice_count"), E.money_sum("invoice_amount").alias("invoice_value"))
        .orderBy("month")
    )


def credit_utilization(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """DB-8: open AR over credit limit per customer (NULL when the limit is 0)."""
    ar = _open(invoices).groupBy("customer_id").agg(F.sum(F.col("invoice_amount").cast("decimal(18,2)")).alias("ar"))
    c = customers.select("customer_id", "name", "credit_limit")
    j = c.join(ar, "customer_id", "left")
    open_ar = F.coalesce(F.col("ar"), F.lit(0)).cast("double")
    return j.select(
        "customer_id", "name", "credit_limit", open_ar.alias("open_ar"),
        E.pct(open_ar, F.when(F.col("credit_limit") != 0, F.col("credit_limit"))).alias("utilization_pct"),
    )


def ar_concentration(invoices: DataFrame) -> DataFrame:
    """DB-8: each customer's share of open AR; the total is a broadcast one-row aggregate."""
    known = _open(invoices).where(F.col("customer_id").isNotNull())
    ar = known.groupBy("customer_id").agg(F.sum(F.col("invoice_amount").cast("decimal(18,2)")).alias("ar"))
    total = ar.agg(F.sum("ar").alias("all_ar"))
    return ar.crossJoin(F.broadcast(total)).select(
        "customer_id",
        F.col("ar").cast("double").alias("open_ar"),
        E.pct(F.col("ar").cast("double"), F.col("all_ar").cast("double")).alias("share_pct"),
    ).orderBy(F.desc("open_ar"), "customer_id")


def invoice_explorer(invoices: DataFrame, statuses=("open",), customer_search: str = "", min_amount: float = 0) -> DataFrame:
    """FN-12: status filter, case-insensitive customer id search (NULL never matches), minimum amount."""
    df = invoices.where(F.col("status").isin(list(statuses)))
    if customer_search:
        df = df.where(F.coalesce(F.lower("customer_id").contains(customer_search.lower()), F.lit(False)))
    df = df.where(F.col("invoice_amount") >= min_amount)
    return df.select("invoice_id", "customer_id", "invoice_amount", "issue_date", "due_date", "status").orderBy(
        F.desc("due_date"), "invoice_id"
    )


def dataset_profile(invoices: DataFrame, payments: DataFrame, customers: DataFrame) -> DataFrame:
    """DB-9: status counts with share, late payment rate, AR and mean invoice, customers per industry.

    Returned as a long (metric, key, value) table: one row per statistic. Each table is scanned once: invoice
    statistics come from one per-status aggregate (at most a handful of rows), customer statistics from one
    per-industry aggregate, and the late rate from the payment x invoice join.
    """
    dec = F.col("invoice_amount").cast("decimal(18,2)")
    st = invoices.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(dec).alias("amt"))
    tot = st.agg(
        F.sum("n").alias("all_n"),
        F.sum(F.when(F.col("status") == "open", F.col("amt"))).alias("ar"),
        F.sum("amt").alias("tot"),
    )
    none = F.lit(None).cast("string")
    by_status = st.select(F.lit("status_count").alias("metric"), F.col("status").alias("key"), F.col("n").cast("double").alias("value")).union(
        st.crossJoin(F.broadcast(tot)).select(F.lit("status_pct"), F.col("status"), E.pct("n", "all_n", 1))
    )
    late = payments.select("invoice_id", "payment_date").join(invoices.select("invoice_id", "due_date"), "invoice_id").agg(
        E.pct(F.count_if(F.datediff("payment_date", "due_date") > 0), F.count(F.lit(1)), 1).alias("value")
    )
    industry = customers.groupBy("industry").agg(F.count(F.lit(1)).cast("double").alias("value"))
    scalars = (
        tot.select(F.lit("total_invoices"), none, F.col("all_n").cast("double"))
        .union(tot.select(F.lit("total_ar"), none, F.coalesce(F.col("ar"), F.lit(0)).cast("double")))
        .union(tot.select(F.lit("avg_invoice"), none, E.money2(F.col("tot").cast("double") / F.col("all_n"))))
        .union(late.select(F.lit("late_payment_rate"), none, "value"))
        .union(payments.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("total_payments"), none, "v"))
        .union(industry.agg(F.sum("value").alias("v")).select(F.lit("total_customers"), none, "v"))
    )
    return by_status.union(scalars).union(
        industry.select(F.lit("industry_customers"), F.col("industry"), "value")
    )
