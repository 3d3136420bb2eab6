"""AR metrics (AR-5..AR-11): DSO, CEI, payment behaviour, customer risk and the AR summary.

Each metric is one pass of conditional aggregates (``sum(when ...)``) instead of one scan per number; the scalar
results come back as one-row DataFrames so they compose with ``crossJoin`` and stay lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E


def _dec(c) -> F.Column:
    return E.col(c).cast("decimal(18,2)")


def _sum_when(cond, amount="invoice_amount") -> F.Column:
    return F.coalesce(F.sum(F.when(cond, _dec(amount))), F.lit(0).cast("decimal(28,2)"))


def _dso_parts(as_of, period_days: int):
    """Aggregate columns and the final expression of DSO, so several metrics can share one scan."""
    cutoff = F.date_sub(E.as_of_lit(as_of), period_days)
    aggs = [
        _sum_when(F.col("status") == "open").alias("dso_current_ar"),
        _sum_when(F.col("issue_date") >= cutoff).alias("dso_period_sales"),
    ]
    sales = F.col("dso_period_sales")
    ratio = F.col("dso_current_ar").cast("double") / sales.cast("double") * period_days
    return aggs, F.when(sales == 0, F.lit(0.0)).otherwise(E.round_dec(ratio, 2))


def dso(invoices: DataFrame, as_of, period_days: int = 90) -> DataFrame:
    """AR-5: open AR / sales issued since ``as_of - period_days`` x period; 0 without sales; rounded to 2."""
    aggs, final = _dso_parts(as_of, period_days)
    return invoices.agg(*aggs).select(final.alias("dso"))


def dso_anchored(invoices: DataFrame, window_days: int = 90) -> DataFrame:
    """AR-6: dashboard DSO, anchored on the latest issue date instead of ``as_of``; unrounded."""
    latest = invoices.agg(F.max("issue_date").alias("latest_issue"))
    joined = invoices.select("status", "issue_date", "invoice_amount").crossJoin(F.broadcast(latest))
    agg = joined.agg(
        _sum_when(F.col("status") == "open").alias("open_ar"),
        _sum_when(F.col("issue_date") >= F.date_sub("latest_issue", window_days)).alias("recent_revenue"),
    )
    daily = agg.recent_revenue.cast("double") / window_days
    return agg.select(
        F.when(agg.recent_revenue > 0, F.when(daily > 0, agg.open_ar.cast("double") / daily).otherwise(0.0))
        .otherwise(0.0)
        .alias("dso")
    )


def _cei_parts(as_of, period_days: int):
    end = E.as_of_lit(as_of)
    start = F.date_sub(end, period_days)
    is_open = F.col("status") == "open"
    aggs = [
        _sum_when((F.col("issue_date") < start) & is_open).alias("cei_beginning_ar"),
        _sum_when((F.col("issue_date") >= start) & (F.col("issue_date") < end)).alias("cei_credit_sales"),
        _sum_when(is_open).alias("cei_ending_ar"),
        _sum_when(is_open & (F.col("due_date") >= end)).alias("cei_ending_current_ar"),
    ]
    b, c = F.col("cei_beginning_ar"), F.col("cei_credit_sales")
    num = (b + c - F.col("cei_ending_ar")).cast("double")
    den = (b + c - F.col("cei_ending_current_ar")).cast("double")
    value = E.round_dec(F.greatest(F.lit(0.0), F.least(F.lit(100.0), num / den * 100)), 2)
    return aggs, F.when(den == 0, F.lit(100.0)).otherwise(value)


def cei(invoices: DataFrame, as_of, period_days: int = 90) -> DataFrame:
    """AR-7: collection effectiveness index, clamped to 0..100, 100 when the denominator is 0."""
    aggs, final = _cei_parts(as_of, period_days)
    return invoices.agg(*aggs).select(final.alias("cei"))


def payment_pairs(invoices: DataFrame, payments: DataFrame, completed_only: bool = False) -> DataFrame:
    """Invoice x payment pairs (inner join on invoice_id). By default every payment status counts (D1)."""
    pay = payments
    if completed_only:
        pay = pay.where(F.col("status") == "completed")
    pay = pay.select("invoice_id", "payment_date")
    return invoices.join(pay, "invoice_id", "inner")


def _pair_stats(invoices: DataFrame, payments: DataFrame, completed_only: bool) -> DataFrame:
    pairs = payment_pairs(invoices, payments, completed_only).select(
        F.datediff("payment_date", "issue_date").alias("days_to_payment"),
        E.days_late("payment_date", "due_date").alias("days_late"),
    )
    late = F.col("days_late") > 0
    return pairs.agg(
        F.count(F.lit(1)).alias("paid_invoices"),
        F.avg("days_to_payment").alias("avg_dtp"),
        F.median("days_to_payment").alias("med_dtp"),
        F.count_if(late).alias("late_payment_count"),
        F.avg(F.when(late, F.col("days_late"))).alias("avg_late"),
        F.median(F.when(late, F.col("days_late"))).alias("med_late"),
        F.max(F.when(late, F.col("days_late"))).alias("max_late"),
    )


BEHAVIOR_COLUMNS = [
    "total_invoices", "paid_invoices", "payment_rate", "avg_days_to_payment", "median_days_to_payment",
    "late_payment_count", "late_payment_rate", "avg_days_late", "median_days_late", "max_days_late",
]


def _behavior_final() -> list[F.Column]:
    return [
        F.col("total_invoices"),
        F.col("paid_invoices"),
        F.coalesce(E.pct("paid_invoices", "total_invoices"), F.lit(0.0)).alias("payment_rate"),
        E.round_dec("avg_dtp", 2).alias("avg_days_to_payment"),
        E.round_dec("med_dtp", 2).alias("median_days_to_payment"),
        F.col("late_payment_count"),
        F.coalesce(E.pct("late_payment_count", "paid_invoices"), F.lit(0.0)).alias("late_payment_rate"),
        F.coalesce(E.round_dec("avg_late", 2), F.lit(0.0)).alias("avg_days_late"),
        F.coalesce(E.round_dec("med_late", 2), F.lit(0.0)).alias("median_days_late"),
        F.coalesce(F.col("max_late"), F.lit(0)).cast("int").alias("max_days_late"),
    ]


def payment_behavior(invoices: DataFrame, payments: DataFrame, completed_only: bool = False) -> DataFrame:
    """AR-8: payment rate, days to pay, late counts and days late (late pairs only, D2). One row."""
    t = invoices.agg(F.count(F.lit(1)).alias("total_invoices"))
    return t.crossJoin(_pair_stats(invoices, payments, completed_only)).select(*_behavior_final())


def payment_behavior_from_status(invoices: DataFrame) -> DataFrame:
    """AR-9: behaviour without a payments table: totals from the status column only."""
    agg = invoices.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("status") == "paid").alias("paid_invoices"),
    )
    return agg.select(
        "total_invoices", "paid_invoices",
        F.coalesce(E.pct("paid_invoices", "total_invoices"), F.lit(0.0)).alias("payment_rate"),
    )


def customer_risk(
    invoices: DataFrame, customers: DataFrame, payments: DataFrame | None = None, completed_only: bool = False
) -> DataFrame:
    """AR-10: per-customer risk score from late rate, days late, AR concentration and open count.

    Invoice-side and payment-side statistics are two ``groupBy(customer_id)`` aggregates joined once (instead of
    a loop over customers). Every join runs at customer grain after map-side partial aggregation, so a customer
    holding a large share of the invoices never lands in one task. Only customers present in ``customers`` with at
    least one invoice appear (D7); the concentration denominator is a one-row aggregate over those rows, broadcast
    to all of them.
    """
    cust = customers.select("customer_id", "name")
    inv = invoices
    base = inv.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("status") == "open").alias("open_invoices"),
        F.sum(F.when(F.col("status") == "open", _dec("invoice_amount"))).alias("ar_dec"),
        F.count_if(F.col("status") == "paid").alias("paid_status"),
    )
    if payments is not None:
        pairs = payment_pairs(inv, payments, completed_only).select(
            "customer_id", E.days_late("payment_date", "due_date").alias("days_late")
        )
        hist = pairs.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("paid_invoices"),
            F.count_if(F.col("days_late") > 0).alias("late_invoices"),
            F.avg("days_late").alias("avg_late_raw"),
        )
        base = base.join(hist, "customer_id", "left")
        paid = F.coalesce(F.col("paid_invoices"), F.lit(0))
        late_n = F.coalesce(F.col("late_invoices"), F.lit(0))
        late_rate = F.coalesce(E.pct("late_invoices", "paid_invoices"), F.lit(0.0))
        avg_late = F.coalesce(E.round_dec("avg_late_raw", 2), F.lit(0.0))
    else:
        paid = F.col("paid_status")
        late_n, late_rate, avg_late = F.lit(0), F.lit(0.0), F.lit(0.0)
    base = base.join(cust.select("customer_id").distinct(), "customer_id", "left_semi")
    base = base.select(
        "customer_id", "total_invoices", "open_invoices",
        F.coalesce(F.col("ar_dec"), F.lit(0).cast("decimal(28,2)")).alias("ar_dec"),
        paid.cast("long").alias("paid_invoices"), late_n.cast("long").alias("late_invoices"),
        late_rate.alias("late_rate"), avg_late.alias("avg_days_late"),
    )
    total = base.agg(F.sum("ar_dec").alias("all_ar"))
    scored = base.crossJoin(F.broadcast(total)).withColumn(
        "ar_concentration",
        F.when(F.col("all_ar") > 0, E.pct(F.col("ar_dec").cast("double"), F.col("all_ar").cast("double")))
        .otherwise(F.lit(0.0)),
    )
    score = (
        F.col("late_rate") * 0.4
        + F.least(F.col("avg_days_late") / 90 * 100, F.lit(100.0)) * 0.3
        + F.least(F.col("ar_concentration"), F.lit(100.0)) * 0.2
        + F.least(F.col("open_invoices") / 10 * 100, F.lit(100.0)) * 0.1
    )
    return (
        scored.withColumn("risk_score", E.round_dec(score, 2))
        .join(cust, "customer_id", "inner")
        .select(
            "customer_id", "name", "total_invoices", "open_invoices",
            F.col("ar_dec").cast("double").alias("total_ar"),
            "paid_invoices", "late_invoices", "late_rate", "avg_days_late", "ar_concentration", "risk_score",
        )
        .orderBy(F.desc("risk_score"), "customer_id")
    )


def ar_summary(invoices: DataFrame, payments: DataFrame | None, as_of, period_days: int = 90) -> DataFrame:
    """AR-11: headline AR numbers, DSO, CEI and payment behaviour in one row.

    Every invoice-level number (AR, overdue, DSO and CEI parts, counts) comes from one scan of the invoices; the
    payment statistics need the invoice x payment join and are a second one-row aggregate.
    """
    a = E.as_of_lit(as_of)
    is_open = F.col("status") == "open"
    dso_aggs, dso_final = _dso_parts(as_of, period_days)
    cei_aggs, cei_final = _cei_parts(as_of, period_days)
    head = invoices.agg(
        _sum_when(is_open).alias("ar"),
        F.count_if(is_open).alias("open_invoices"),
        _sum_when(is_open & (F.col("due_date") < a)).alias("od"),
        F.count_if(is_open & (F.col("due_date") < a)).alias("overdue_invoices"),
        F.avg(F.when(is_open, _dec("invoice_amount"))).alias("avg_open"),
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("status") == "paid").alias("paid_status"),
        *dso_aggs, *cei_aggs,
    )
    cols = [
        F.col("ar").cast("double").alias("total_ar"),
        "open_invoices",
        F.col("od").cast("double").alias("overdue_ar"),
        "overdue_invoices",
        F.when(F.col("ar") > 0, E.pct(F.col("od").cast("double"), F.col("ar").cast("double")))
        .otherwise(F.lit(0.0))
        .alias("overdue_percentage"),
        F.coalesce(E.round_dec("avg_open", 2), F.lit(0.0)).alias("avg_invoice_amount"),
        dso_final.alias("dso"),
        cei_final.alias("cei"),
    ]
    if payments is None:
        return head.select(
            *cols, "total_invoices", F.col("paid_status").alias("paid_invoices"),
            F.coalesce(E.pct("paid_status", "total_invoices"), F.lit(0.0)).alias("payment_rate"),
        )
    return head.crossJoin(_pair_stats(invoices, payments, False)).select(*cols, *_behavior_final())
