"""Registered queries: aging and calendar expressions (AR-1..4, FN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import aging
from receivables.plans.catalog import AS_OF, AS_OF_SQL, register
from receivables.plans.sqlfrag import bucket6, msum, overdue, pct

A = AS_OF_SQL


@register(
    "aging_invoices", "AR-1 / FN-1 / FN-2",
    f"""
SELECT invoice_id, customer_id, due_date, status, invoice_amount,
       CAST({overdue('due_date', A)} AS int) AS days_overdue,
       {bucket6(overdue('due_date', A))} AS aging_bucket
FROM invoices""",
    views=("invoices",),
)
def q_aging_invoices(fx):
    return aging.calculate_aging(fx.invoices, AS_OF).select(
        "invoice_id", "customer_id", "due_date", "status", "invoice_amount",
        F.col("days_overdue").cast("int").alias("days_overdue"), "aging_bucket",
    )


@register(
    "aging_summary", "AR-2",
    f"""
WITH g AS (
  SELECT {bucket6(overdue('due_date', A))} AS aging_bucket,
         {msum('invoice_amount')} AS total_amount,
         count(invoice_amount) AS amount_count, count(invoice_id) AS invoice_count
  FROM invoices WHERE status = 'open' GROUP BY 1)
SELECT aging_bucket, total_amount, amount_count, invoice_count,
       CASE WHEN t > 0 THEN {pct('total_amount', 't')} ELSE 0.0 END AS percentage
FROM (SELECT *, CAST(sum(CAST(total_amount AS decimal(28,2))) OVER () AS double) AS t FROM g) x""",
    views=("invoices",),
)
def q_aging_summary(fx):
    return aging.aging_summary(fx.invoices, AS_OF)


def _pivot_cols(src_bucket: str, amount: str) -> str:
    out = []
    for b in E.AGING_BUCKETS:
        out.append(
            f"CAST(coalesce(sum(CASE WHEN {src_bucket} = '{b}' THEN CAST({amount} AS decimal(18,2)) END), 0) AS double) AS \"{b}\""
        )
    return ",\n       ".join(out)


@register(
    "customer_aging", "AR-3",
    f"""
WITH a AS (SELECT customer_id, invoice_amount, {bucket6(overdue('due_date', A))} AS b
           FROM invoices WHERE status = 'open' AND customer_id IS NOT NULL),
w AS (SELECT customer_id, {msum('invoice_amount')} AS total_ar,
       {_pivot_cols('b', 'invoice_amount')}
      FROM a GROUP BY customer_id)
SELECT w.customer_id, c.name, w.* EXCLUDE (customer_id)
FROM w LEFT JOIN customers c ON w.customer_id = c.customer_id""",
    views=("invoices", "customers"),
)
def q_customer_aging(fx):
    return aging.customer_aging(fx.invoices, fx.customers, AS_OF)


@register(
    "aging_trend", "AR-4",
    f"""
WITH base AS (SELECT CASE WHEN last_day({A}) = {A} THEN {A} ELSE last_day({A} - INTERVAL 1 MONTH) END AS b),
ends AS (SELECT CAST(last_day(b - to_months(CAST(i AS int))) AS DATE) AS month_end FROM base, range(6) t(i)),
fp AS (SELECT invoice_id, min(payment_date) AS first_paid FROM payments GROUP BY invoice_id),
snap AS (
  SELECT e.month_end, i.invoice_amount,
         {bucket6(overdue('i.due_date', 'e.month_end'))} AS b
  FROM invoices i LEFT JOIN fp ON i.invoice_id = fp.invoice_id CROSS JOIN ends e
  WHERE i.issue_date <= e.month_end AND (fp.first_paid IS NULL OR fp.first_paid > e.month_end)),
w AS (SELECT month_end, {_pivot_cols('b', 'invoice_amount')} FROM snap GROUP BY month_end)
SELECT strftime(e.month_end, '%Y-%m') AS month,
       {", ".join(f'CAST(coalesce(w."{b}", 0) AS double) AS "{b}"' for b in E.AGING_BUCKETS)},
       CAST({" + ".join(f'CAST(coalesce(w."{b}", 0) AS decimal(38,2))' for b in E.AGING_BUCKETS)} AS double) AS total_ar
FROM ends e LEFT JOIN w ON e.month_end = w.month_end""",
    views=("invoices", "payments"),
)
def q_aging_trend(fx):
    return aging.aging_trend(fx.invoices, fx.payments, AS_OF, months=6)


@register(
    "calendar_features", "FN-1 / FN-5 / FN-6 / FN-7 / FN-9",
    f"""
SELECT invoice_id,
       CAST(date_diff('day', issue_date, due_date) AS int) AS days_between,
       CAST({overdue('due_date', A)} AS int) AS days_overdue,
       CAST(date_diff('day', {A}, due_date) AS int) AS days_until_due,
       CAST(due_date - CAST(isodow(due_date) - 1 AS int) AS DATE) AS week_start,
       CAST(due_date - CAST(isodow(due_date) - 1 AS int) + 6 AS DATE) AS week_end,
       CAST(date_trunc('month', due_date) AS DATE) AS month_start,
       last_day(due_date) AS month_end,
       CAST(quarter(due_date) AS int) AS quarter,
       isodow(due_date) >= 6 AS is_weekend,
       strftime(due_date, '%Y-%m-%d') AS due_text,
       strftime(CAST(due_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS due_datetime_text
FROM invoices""",
    views=("invoices",),
)
def q_calendar_features(fx):
    inv = fx.invoices
    ws = E.week_start("due_date")
    return inv.select(
        "invoice_id",
        E.days_between("issue_date", "due_date").alias("days_between"),
        E.days_overdue("due_date", AS_OF).cast("int").alias("days_overdue"),
        E.days_until_due("due_date", AS_OF).cast("int").alias("days_until_due"),
        ws.alias("week_start"),
        F.date_add(ws, 6).alias("week_end"),
        F.trunc("due_date", "MM").alias("month_start"),
        F.last_day("due_date").alias("month_end"),
        F.quarter("due_date").alias("quarter"),
        (F.weekday("due_date") >= 5).alias("is_weekend"),
        F.date_format("due_date", "yyyy-MM-dd").alias("due_text"),
        F.date_format(F.col("due_date").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("due_datetime_text"),
    )


@register(
    "business_days", "FN-8",
    f"""
SELECT invoice_id,
       CAST(CASE WHEN issue_date > due_date THEN 0 ELSE
         (SELECT count(*) FROM range(0, date_diff('day', issue_date, due_date) + 1) r(k)
          WHERE isodow(issue_date + CAST(k AS int)) <= 5) END AS int) AS business_days
FROM invoices""",
    views=("invoices",),
)
def q_business_days(fx):
    return fx.invoices.select("invoice_id", E.business_days("issue_date", "due_date").cast("int").alias("business_days"))
