"""Customer history as of each invoice's own issue date (FE-2 point in time): no row sees a later invoice or payment.

The history of ``customer_history`` at a date counts the customer's invoice-payment rows that are complete before that date:
the invoice was issued, and its payment, if it has any, was made. So every row becomes known on one day, the later of its issue and
payment dates, and the history at a date is the sum over the days before it. Rows known on the same day are added up first,
which leaves a customer with at most one row per calendar day, however many invoices it has; the running sums over those days
are the only ordered work, and a customer with a third of all rows is as cheap as any other. Invoices then meet the sums on
(customer, issue date), a key that spreads a large customer over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.functions import expr as E

SUMS = ("rows", "late_sum", "late_n", "late_rows", "paid_sum", "paid_n")


def daily_changes(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """(customer_id, day) and what becomes known on that day: rows, their days late, late rows, amounts paid."""
    inv = invoices.where(F.col("issue_date").isNotNull() & F.col("customer_id").isNotNull()).select("invoice_id", "customer_id", "issue_date", "due_date")
    pay = payments.select("invoice_id", "payment_date", F.col("amount").alias("paid"))
    known = inv.join(pay, "invoice_id", "left")
    late = F.when(F.col("payment_date").isNull(), F.lit(0)).otherwise(E.days_late("payment_date", "due_date"))
    known = known.select("customer_id", F.greatest("issue_date", "payment_date").alias("day"), late.alias("late"), F.col("paid").cast("decimal(18,2)").alias("paid"))
    return known.groupBy("customer_id", "day").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("late").cast("long")).alias("late_sum"), F.count("late").alias("late_n"),
        F.count_if(F.col("late") > 0).alias("late_rows"),
        F.sum("paid").alias("paid_sum"), F.count("paid").alias("paid_n"),
    )


def history_by_day(invoices: DataFrame, payments: DataFrame, asked: DataFrame) -> DataFrame:
    """``customer_history`` as of each (customer_id, day) of ``asked``; a customer's first day has no row."""
    changes = daily_changes(invoices, payments).withColumn("asked", F.lit(False))
    zeros = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in SUMS]
    days = asked.where(F.col("customer_id").isNotNull() & F.col("day").isNotNull()).select("customer_id", "day").distinct()
    all_days = changes.unionByName(days.select("customer_id", "day", *zeros, F.lit(True).alias("asked")))
    all_days = all_days.groupBy("customer_id", "day").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("asked").alias("asked"))
    # At most one row per calendar day in a window.
    before = Window.partitionBy("customer_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    upto = all_days.select("customer_id", "day", "asked", *[F.sum(c).over(before).alias(c) for c in SUMS]).where("asked and rows > 0")
    return upto.select(
        "customer_id", "day", F.col("rows").alias("customer_invoice_count"),
        F.coalesce(F.try_divide(F.col("late_sum").cast("double"), F.col("late_n")), F.lit(0.0)).alias("customer_avg_days_late"),
        E.pct("late_rows", "rows").alias("customer_late_rate"),
        F.try_divide(F.col("paid_sum").cast("double"), F.col("paid_n")).alias("customer_avg_payment_amount"),
    )


def history_at_issue(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """invoice_id, customer_id, issue_date and the customer's history before that date; invoices without an earlier row, a
    date or a customer have 0 rows, no lateness and no mean payment."""
    asked = invoices.select("customer_id", F.col("issue_date").alias("day"))
    known = history_by_day(invoices, payments, asked).withColumnRenamed("day", "issue_date")
    out = invoices.select("invoice_id", "customer_id", "issue_date").join(known, ["customer_id", "issue_date"], "left")
    return out.select(
        "invoice_id", "customer_id", "issue_date", F.coalesce("customer_invoice_count", F.lit(0).cast("long")).alias("customer_invoice_count"),
        F.coalesce("customer_avg_days_late", F.lit(0.0)).alias("customer_avg_days_late"),
        F.coalesce("customer_late_rate", F.lit(0.0)).alias("customer_late_rate"), "customer_avg_payment_amount",
    )
