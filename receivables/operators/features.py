"""Model features (FE-1), customer payment history (FE-2) and the late-payment label (FE-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.functions.joins import lookup_join
from receivables.operators.history import history_by_day

# The 25 model features, in model order.
FEATURE_COLUMNS = [
    "days_until_due", "days_since_issue", "payment_term_days", "issue_month", "issue_quarter", "issue_day_of_week",
    "issue_is_weekend", "due_month", "due_quarter", "due_day_of_week", "due_is_weekend", "invoice_amount_log",
    "invoice_amount_sqrt", "credit_limit_log", "credit_utilization", "customer_invoice_count", "customer_avg_days_late",
    "customer_late_rate", "customer_ar_concentration", "invoice_type_recurring", "invoice_type_milestone",
    "channel_online", "amount_x_days_until_due", "amount_x_late_rate", "utilization_x_late_rate",
]

HISTORY_COLUMNS = ["customer_invoice_count", "customer_avg_days_late", "customer_late_rate", "customer_avg_payment_amount"]


def late_target(invoices: DataFrame, payments: DataFrame, late_threshold_days: int = 7) -> DataFrame:
    """FE-3: one row per invoice x payment (unpaid invoices once); is_late = days paid after due > threshold."""
    return late_rows(invoices.join(payments.select("invoice_id", "payment_date"), "invoice_id", "left"), late_threshold_days)


def late_rows(j: DataFrame, late_threshold_days: int = 7) -> DataFrame:
    """The label of rows that hold an invoice and its payment."""
    days_late = F.when(F.col("payment_date").isNull(), F.lit(0)).otherwise(
        E.days_late("payment_date", "due_date")
    )
    late = F.coalesce(F.col("days_late") > late_threshold_days, F.lit(False))  # unknown dates are not late
    return j.withColumn("days_late", days_late).withColumn("is_late", late.cast("int"))


def customer_history(invoices: DataFrame, payments: DataFrame, as_of) -> DataFrame:
    """FE-2: per customer, over invoices issued before ``as_of`` and payments before ``as_of`` (or none):
    invoice-payment rows, mean days late (unpaid = 0), late rate %, mean payment amount (D21: rows paid on or after
    ``as_of`` are dropped, not treated as unpaid)."""
    a = E.as_of_lit(as_of)
    inv = invoices.where((F.col("issue_date") < a) & F.col("customer_id").isNotNull()).select("invoice_id", "customer_id", "due_date")
    pay = payments.select("invoice_id", "payment_date", F.col("amount").alias("pay_amount"))
    m = inv.join(pay, "invoice_id", "left").where(F.col("payment_date").isNull() | (F.col("payment_date") < a))
    g = m.withColumn("dl", days_late_or_none()).groupBy("customer_id").agg(*history_sums(F.lit(True)))
    return g.select("customer_id", *history_values())


def days_late_or_none():
    return F.when(F.col("payment_date").isNull(), F.lit(0)).otherwise(E.days_late("payment_date", "due_date"))


def history_sums(known) -> list:
    """Per customer, over the rows that are ``known``: what the history is made of."""
    return [
        F.count(F.when(known, F.col("invoice_id"))).alias("customer_invoice_count"),
        F.avg(F.when(known, F.col("dl"))).alias("customer_avg_days_late"),
        F.count_if(known & (F.col("dl") > 0)).alias("late_count"),
        F.sum(F.when(known, F.col("pay_amount").cast("decimal(18,2)"))).alias("pay_sum"),
        F.count(F.when(known, F.col("pay_amount"))).alias("pay_n"),
    ]


def history_values() -> list:
    return [
        F.col("customer_invoice_count"),
        F.coalesce(F.col("customer_avg_days_late"), F.lit(0.0)).alias("customer_avg_days_late"),
        E.pct("late_count", "customer_invoice_count").alias("customer_late_rate"),
        F.try_divide(F.col("pay_sum").cast("double"), F.col("pay_n")).alias("customer_avg_payment_amount"),
    ]


def open_amount():
    return F.sum(F.when(F.col("status") == "open", F.col("invoice_amount").cast("decimal(18,2)"))).alias("customer_total_ar")


def customer_sums(paid: DataFrame, as_of) -> DataFrame:
    """Per customer (NULL too) of invoices with their payments (``pay_amount``), in one pass: open AR, rows (``__n``), and the history
    (FE-2), which is NULL where no row of the customer is known."""
    a = E.as_of_lit(as_of)
    known = F.coalesce((F.col("issue_date") < a) & (F.col("payment_date").isNull() | (F.col("payment_date") < a)), F.lit(False))
    g = paid.withColumn("dl", days_late_or_none()).groupBy("customer_id").agg(
        open_amount(), F.count(F.lit(1)).alias("__n"), F.count_if(known).alias("__known"), *history_sums(known)
    )
    values = [F.when(F.col("__known") > 0, v).alias(name) for v, name in zip(history_values(), HISTORY_COLUMNS, strict=True)]
    return g.select("customer_id", "customer_total_ar", "__n", *values)


def engineer_features(
    invoices: DataFrame, customers: DataFrame, payments: DataFrame | None, as_of, history_invoices: DataFrame | None = None,
    point_in_time: bool = False, sums: DataFrame | None = None,
) -> DataFrame:
    """FE-1: calendar, amount, credit, history, concentration, type/channel flags and 3 interactions.

    Per-customer inputs (customer attributes, history, open AR) are combined at customer grain first and meet the
    invoice rows in one join; the AR total is a broadcast one-row aggregate. With ``point_in_time`` the history of an invoice is
    that of its own issue date (``history_by_day``): 0 rows where the customer has none before it. ``sums`` are the
    ``customer_sums`` of these rows, where the caller has them.
    """
    a = E.as_of_lit(as_of)
    df = invoices.select(
        *invoices.columns,
        F.datediff("due_date", a).alias("days_until_due"),
        F.datediff(a, "issue_date").alias("days_since_issue"),
        F.month("issue_date").alias("issue_month"),
        F.quarter("issue_date").alias("issue_quarter"),
        F.weekday("issue_date").alias("issue_day_of_week"),
        (F.weekday("issue_date") >= 5).cast("int").alias("issue_is_weekend"),
        F.month("due_date").alias("due_month"),
        F.quarter("due_date").alias("due_quarter"),
        F.weekday("due_date").alias("due_day_of_week"),
        (F.weekday("due_date") >= 5).cast("int").alias("due_is_weekend"),
        F.datediff("due_date", "issue_date").alias("payment_term_days"),
        F.log1p("invoice_amount").alias("invoice_amount_log"),
        F.sqrt("invoice_amount").alias("invoice_amount_sqrt"),
        E.amount_bucket("invoice_amount").alias("amount_bucket"),
        (F.col("invoice_type") == "recurring").cast("int").alias("invoice_type_recurring") if "invoice_type" in invoices.columns else F.lit(0).alias("invoice_type_recurring"),
        (F.col("invoice_type") == "milestone").cast("int").alias("invoice_type_milestone") if "invoice_type" in invoices.columns else F.lit(0).alias("invoice_type_milestone"),
        (F.col("channel") == "online").cast("int").alias("channel_online") if "channel" in invoices.columns else F.lit(0).alias("channel_online"),
    )
    # Open AR and row count per customer in one aggregate; the grand total and the hot keys follow from it.
    per_key = df.groupBy("customer_id").agg(open_amount(), F.count(F.lit(1)).alias("__n")) if sums is None else sums
    if sums is not None and (payments is None or point_in_time):
        per_key = per_key.drop(*HISTORY_COLUMNS)
    total = per_key.agg(F.sum("customer_total_ar").alias("total_ar"))
    cust_ar = per_key.where(F.col("customer_id").isNotNull()).drop("__n")
    per_cust = customers.select("customer_id", "payment_terms_days", "credit_limit").join(cust_ar, "customer_id", "full")
    past = history_invoices if history_invoices is not None else invoices
    if payments is not None and not point_in_time and sums is None:
        per_cust = per_cust.join(customer_history(past, payments, as_of), "customer_id", "full")
    # One row per customer on the right: hot customers are salted so their invoices spread over many tasks.
    df = lookup_join(df, per_cust, "customer_id", "left", spread="invoice_id", key_counts=per_key).crossJoin(F.broadcast(total))
    if payments is None:
        df = (df.withColumn("customer_invoice_count", F.lit(1)).withColumn("customer_avg_days_late", F.lit(0.0))
              .withColumn("customer_late_rate", F.lit(0.0)).withColumn("customer_avg_payment_amount", F.col("invoice_amount")))
    elif point_in_time:
        asked = df.select("customer_id", F.col("issue_date").alias("day"))
        known = history_by_day(past, payments, asked).withColumnRenamed("day", "issue_date")
        df = df.join(known, ["customer_id", "issue_date"], "left").fillna(0, subset=["customer_invoice_count"])
    util = F.try_divide(F.col("invoice_amount"), F.col("credit_limit"))
    util = F.when(F.col("credit_limit") == 0, F.when(F.col("invoice_amount") > 0, F.lit(2.0)).when(F.col("invoice_amount") < 0, F.lit(0.0)).otherwise(F.lit(0.0))).otherwise(util)
    df = df.select(
        *[c for c in df.columns if c not in ("customer_invoice_count", "customer_avg_days_late", "customer_late_rate",
                                              "customer_avg_payment_amount", "customer_total_ar", "total_ar")],
        F.log1p("credit_limit").alias("credit_limit_log"),
        E.clip(F.coalesce(util, F.lit(0.0)), 0.0, 2.0).alias("credit_utilization"),
        F.coalesce(F.col("customer_invoice_count"), F.lit(1)).cast("long").alias("customer_invoice_count"),
        F.coalesce(F.col("customer_avg_days_late"), F.lit(0.0)).alias("customer_avg_days_late"),
        F.coalesce(F.col("customer_late_rate"), F.lit(0.0)).alias("customer_late_rate"),
        F.coalesce(F.col("customer_avg_payment_amount"), F.col("invoice_amount")).alias("customer_avg_payment_amount"),
        F.col("customer_total_ar").cast("double").alias("customer_total_ar"),
        F.when(F.col("total_ar") > 0, F.coalesce(F.col("customer_total_ar").cast("double") / F.col("total_ar").cast("double") * 100, F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("customer_ar_concentration"),
    )
    return (
        df.withColumn("amount_x_days_until_due", F.col("invoice_amount_log") * F.col("days_until_due"))
        .withColumn("amount_x_late_rate", F.col("invoice_amount_log") * F.col("customer_late_rate"))
        .withColumn("utilization_x_late_rate", F.col("credit_utilization") * F.col("customer_late_rate"))
    )
