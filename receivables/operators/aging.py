"""Invoice aging (AR-1..AR-4).

All operators are lazy ``DataFrame -> DataFrame`` functions with an explicit ``as_of`` date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.functions import expr as E


def calculate_aging(invoices: DataFrame, as_of) -> DataFrame:
    """AR-1: add ``days_overdue`` (floor days past due, >= 0, NULL due -> 0) and ``aging_bucket``."""
    return invoices.withColumn("days_overdue", E.days_overdue("due_date", as_of)).withColumn(
        "aging_bucket", E.aging_bucket("days_overdue")
    )


def _with_share(df: DataFrame, amount_col: str, out: str = "percentage") -> DataFrame:
    # The input has at most one row per bucket (<= 6 rows), so an unpartitioned window is a tiny
    # single-task step after the shuffle-free partial aggregation, never a scan of the fact table.
    total = F.sum(F.col(amount_col).cast("decimal(28,2)")).over(Window.partitionBy()).cast("double")
    return df.withColumn(out, F.when(total > 0, E.pct(amount_col, total)).otherwise(F.lit(0.0)))


def aging_summary(invoices: DataFrame, as_of) -> DataFrame:
    """AR-2: open AR by aging bucket with amount, counts and share of the total (bucket order)."""
    aged = calculate_aging(invoices.where(F.col("status") == "open"), as_of)
    summary = aged.groupBy("aging_bucket").agg(
        E.money_sum("invoice_amount").alias("total_amount"),
        F.count("invoice_amount").alias("amount_count"),
        F.count("invoice_id").alias("invoice_count"),
    )
    return (
        _with_share(summary, "total_amount")
        .orderBy(E.aging_bucket_order("aging_bucket"))
        .select("aging_bucket", "total_amount", "amount_count", "invoice_count", "percentage")
    )


def customer_aging(invoices: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    """AR-3: open AR per customer with one column per bucket (always all six, zero-filled)."""
    aged = calculate_aging(invoices.where((F.col("status") == "open") & F.col("customer_id").isNotNull()), as_of)
    wide = (
        aged.withColumn("amt", F.col("invoice_amount").cast("decimal(18,2)"))
        .groupBy("customer_id")
        .pivot("aging_bucket", E.AGING_BUCKETS)
        .agg(F.sum("amt"))
    )
    buckets = [F.coalesce(F.col(f"`{b}`"), F.lit(0)).cast("double").alias(b) for b in E.AGING_BUCKETS]
    total = sum((F.coalesce(F.col(f"`{b}`"), F.lit(0)) for b in E.AGING_BUCKETS), F.lit(0))
    wide = wide.select("customer_id", total.cast("double").alias("total_ar"), *buckets)
    names = customers.select("customer_id", "name")
    return (
        wide.join(names, "customer_id", "left")
        .select("customer_id", "name", "total_ar", *[F.col(f"`{b}`") for b in E.AGING_BUCKETS])
        .orderBy(F.desc("total_ar"), "customer_id")
    )


def month_ends(spark, as_of, months: int = 6) -> DataFrame:
    """The last ``months`` calendar month ends on or before ``as_of`` (a ``months``-row DataFrame)."""
    a = E.as_of_lit(as_of).cast("date")
    base = F.when(F.last_day(a) == a, a).otherwise(F.last_day(F.add_months(a, -1)))
    return spark.range(months).select(F.last_day(F.add_months(base, -F.col("id").cast("int"))).alias("month_end"))


def bucket_events(invoices: DataFrame, payments: DataFrame | None) -> DataFrame:
    """(day, bucket, amount): what enters (+) and leaves (-) an aging bucket on a day, summed per day and bucket.

    An invoice is open from its issue date up to the day before its first payment (without payments: while ``status`` is
    open, for good). Meanwhile it moves through the buckets at fixed distances from its due date, so it makes at most two
    events per bucket, whatever the number of dates asked for. Without a due date it stays current.
    """
    inv = invoices.where(F.col("issue_date").isNotNull()).select("invoice_id", "issue_date", "due_date", F.col("invoice_amount").cast("decimal(18,2)").alias("amt"), "status")
    if payments is not None:
        inv = inv.join(payments.groupBy("invoice_id").agg(F.min("payment_date").alias("end")), "invoice_id", "left")
    else:
        inv = inv.where(F.col("status") == "open").withColumn("end", F.lit(None).cast("date"))
    steps = []
    bounds = [None, 1, 16, 31, 61, 91, None]  # days overdue at which each bucket begins
    for bucket, lo, hi in zip(E.AGING_BUCKETS, bounds, bounds[1:]):
        due = F.col("due_date")
        enter = F.col("issue_date") if lo is None else F.greatest("issue_date", F.date_add(due, lo))
        leave = F.col("end") if hi is None else F.least("end", F.date_add(due, hi))
        here = (leave.isNull() | (enter < leave)) if lo is None else due.isNotNull() & (leave.isNull() | (enter < leave))
        steps.append(F.when(here, F.struct(F.lit(bucket).alias("bucket"), enter.alias("day"), F.col("amt").alias("amount"))))
        steps.append(F.when(here & leave.isNotNull(), F.struct(F.lit(bucket).alias("bucket"), leave.alias("day"), (-F.col("amt")).cast("decimal(18,2)").alias("amount"))))
    moved = inv.select(F.explode(F.filter(F.array(*steps), lambda e: e.isNotNull())).alias("e")).select("e.*")
    return moved.groupBy("day", "bucket").agg(F.sum("amount").alias("amount"))


def aging_at(invoices: DataFrame, payments: DataFrame | None, days: DataFrame) -> DataFrame:
    """Open AR by bucket at the end of each ``day`` of ``days``: running sums of the bucket events. The window has one row
    per calendar day on which something happens, however many invoices there are."""
    columns = [F.sum(F.when(F.col("bucket") == b, F.col("amount"))).alias(b) for b in E.AGING_BUCKETS]
    changes = bucket_events(invoices, payments).groupBy("day").agg(*columns).withColumn("asked", F.lit(False))
    nothing = [F.lit(None).cast(changes.schema[b].dataType).alias(b) for b in E.AGING_BUCKETS]
    line = changes.unionByName(days.select(F.col("day").cast("date").alias("day"), *nothing, F.lit(True).alias("asked")))
    line = line.groupBy("day").agg(*[F.sum(F.col(f"`{b}`")).alias(b) for b in E.AGING_BUCKETS], F.max("asked").alias("asked"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.select("day", "asked", *[F.coalesce(F.sum(F.col(f"`{b}`")).over(upto), F.lit(0)).alias(b) for b in E.AGING_BUCKETS]).where("asked")
    total = sum((F.col(f"`{b}`") for b in E.AGING_BUCKETS), F.lit(0))
    return line.select("day", *[F.col(f"`{b}`").cast("double").alias(b) for b in E.AGING_BUCKETS], total.cast("double").alias("total_ar"))


def aging_trend(invoices: DataFrame, payments: DataFrame | None, as_of, months: int = 6) -> DataFrame:
    """AR-4: open AR by bucket at each of the last ``months`` month ends.

    An invoice counts at month end ``m`` when it was issued by ``m`` and has no payment dated on or before ``m``. Without
    payments, ``status = 'open'`` decides. The cost does not depend on ``months`` (``aging_at``).
    """
    ends = month_ends(invoices.sparkSession, as_of, months).select(F.col("month_end").alias("day"))
    out = aging_at(invoices, payments, ends)
    return out.select(F.date_format("day", "yyyy-MM").alias("month"), *[F.col(f"`{b}`") for b in E.AGING_BUCKETS], "total_ar").orderBy("month")


def aging_daily(invoices: DataFrame, payments: DataFrame | None, as_of) -> DataFrame:
    """AR-4 as a series: open AR by bucket on every day from the first issue date to ``as_of``."""
    a = E.as_of_lit(as_of).cast("date")
    span = invoices.agg(F.min("issue_date").alias("first")).where(F.col("first") <= a)
    return aging_at(invoices, payments, span.select(F.explode(F.sequence("first", a)).alias("day"))).orderBy("day")
