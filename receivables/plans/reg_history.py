"""Registered queries: point-in-time history (FE-2), daily aging (AR-4), raw cells (SRC-1..3, DQ-3..5),
appends (AU-1, SNK-2), success over ranges (AU-5) and the metrics stream (AU-8)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import activity, aging, audit, features, history
from receivables.plans.catalog import AS_OF, AS_OF_SQL, REGISTRY, register
from receivables.plans.reg_audit import PAIRS
from receivables.plans.sqlfrag import bucket6, days_late, overdue, pct, round_dec
from receivables.session import ensure_checkpoint_dir
from receivables.sources import tables
from receivables.streaming import daily_metrics

# Every pair of an invoice and an earlier invoice-payment row of its customer.
AT_ISSUE_SQL = f"""WITH m AS (
  SELECT i.customer_id, i.invoice_id, i.issue_date, p.payment_date, p.amount,
         CASE WHEN p.payment_date IS NULL THEN 0 ELSE {days_late('p.payment_date', 'i.due_date')} END AS dl
  FROM invoices i LEFT JOIN payments p ON i.invoice_id = p.invoice_id WHERE i.customer_id IS NOT NULL)
SELECT q.invoice_id, q.customer_id, q.issue_date, count(m.invoice_id) AS customer_invoice_count, coalesce(avg(m.dl), 0.0) AS customer_avg_days_late,
       coalesce({pct('count(*) FILTER (WHERE m.dl > 0)', 'count(m.invoice_id)')}, 0.0) AS customer_late_rate,
       CAST(sum(CAST(m.amount AS decimal(18,2))) AS double) / NULLIF(count(m.amount), 0) AS customer_avg_payment_amount
FROM invoices q LEFT JOIN m ON m.customer_id = q.customer_id AND m.issue_date < q.issue_date AND (m.payment_date IS NULL OR m.payment_date < q.issue_date)
GROUP BY q.invoice_id, q.customer_id, q.issue_date"""


@register("history_at_issue", "FE-2", AT_ISSUE_SQL, views=("invoices", "payments"))
def q_history_at_issue(fx):
    return history.history_at_issue(fx.invoices, fx.payments)


def _renamed(sql: str) -> str:
    return sql.replace("invoices i", "invoices_nulls i").replace("invoices q", "invoices_nulls q").replace("payments p", "payments_nulls p")


@register("history_at_issue_nulls", "FE-2", _renamed(AT_ISSUE_SQL), views=("invoices_nulls", "payments_nulls"))
def q_history_at_issue_nulls(fx):
    return history.history_at_issue(fx.invoices_nulls, fx.payments_nulls)


@register(
    "features_at_issue", "FE-1 / FE-2",
    f"""WITH h AS ({AT_ISSUE_SQL})
SELECT i.invoice_id, i.customer_id, i.issue_date, h.customer_invoice_count, h.customer_avg_days_late, h.customer_late_rate,
       CAST(CASE WHEN i.invoice_type = 'recurring' THEN 1 ELSE 0 END AS int) AS invoice_type_recurring,
       CAST(date_diff('day', i.issue_date, i.due_date) AS int) AS payment_term_days,
       coalesce(h.customer_avg_payment_amount, i.invoice_amount) AS customer_avg_payment_amount
FROM invoices i JOIN h USING (invoice_id)""",
    views=("invoices", "payments"),
)
def q_features_at_issue(fx):
    f = features.engineer_features(fx.invoices, fx.customers, fx.payments, AS_OF, point_in_time=True)
    return f.select("invoice_id", "customer_id", "issue_date", "customer_invoice_count", "customer_avg_days_late", "customer_late_rate",
                    "invoice_type_recurring", "payment_term_days", "customer_avg_payment_amount")


_PIVOT = ", ".join(f"""sum(CASE WHEN b = '{b}' THEN CAST(invoice_amount AS decimal(18,2)) END) AS "{b}\"""" for b in E.AGING_BUCKETS)


@register(
    "aging_daily", "AR-4",
    f"""WITH days AS (
  SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST({AS_OF_SQL} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT min(issue_date) AS a FROM invoices) m),
fp AS (SELECT invoice_id, min(payment_date) AS first_paid FROM payments GROUP BY invoice_id),
snap AS (
  SELECT d.day, i.invoice_amount, {bucket6(overdue('i.due_date', 'd.day'))} AS b
  FROM invoices i LEFT JOIN fp ON i.invoice_id = fp.invoice_id
       JOIN days d ON i.issue_date <= d.day AND (fp.first_paid IS NULL OR fp.first_paid > d.day)),
w AS (SELECT day, {_PIVOT} FROM snap GROUP BY day)
SELECT d.day, {", ".join(f'CAST(coalesce(w."{b}", 0) AS double) AS "{b}"' for b in E.AGING_BUCKETS)},
       CAST({" + ".join(f'CAST(coalesce(w."{b}", 0) AS decimal(38,2))' for b in E.AGING_BUCKETS)} AS double) AS total_ar
FROM days d LEFT JOIN w ON d.day = w.day""",
    views=("invoices", "payments"),
)
def q_aging_daily(fx):
    return aging.aging_daily(fx.invoices, fx.payments, AS_OF)


# The fixture tables as CSV with texts in place of some values; the first hex digit of a hash of the key decides.
_SPOILED = {
    "customers": ("customer_id", {"payment_terms_days": ("3", "net 30"), "credit_limit": ("7", "10,000"), "created_at": ("b", "someday")}),
    "invoices": ("invoice_id", {"invoice_amount": ("0", "12.5.0"), "issue_date": ("4", "31/31/2001"), "due_date": ("4", "soon"), "created_at": ("c", "2001-02-30")}),
    "payments": ("payment_id", {"amount": ("9", "USD 5"), "payment_date": ("e", "n/a")}),
}


def _spoiled(df, table: str):
    key, columns = _SPOILED[table]
    digit = F.substring(F.md5(key), 1, 1)
    types = tables.column_types(table)
    texts = [F.when(digit == columns[c][0], F.lit(columns[c][1])).otherwise(F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in types]
    return df.select(*texts)


def _cell_sql(table: str) -> str:
    key, columns = _SPOILED[table]
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", 'unreadable:{c}' AS rule, 'error' AS severity, {key} AS key, 'cannot read {c}: {text}' AS message, '{text}' AS raw
FROM {table} WHERE substr(md5({key}), 1, 1) = '{digit}'""" for c, (digit, text) in columns.items())


@register("src_bad_cells", "SRC-1..3 / DQ-3..5", " UNION ALL ".join(_cell_sql(t) for t in _SPOILED), views=tuple(_SPOILED))
def q_src_bad_cells(fx):
    folder = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    for table in _SPOILED:
        tables.save(_spoiled(fx.table(table), table), f"{folder}/{table}.csv", fmt="csv")
    return tables.DataLoader(fx.spark, folder).bad_cells().drop("file")


@register(
    "src_typed_cells", "SRC-2",
    """SELECT invoice_id, CASE WHEN substr(md5(invoice_id), 1, 1) <> '4' THEN issue_date END AS issue_date,
       CASE WHEN substr(md5(invoice_id), 1, 1) <> '4' THEN due_date END AS due_date,
       CASE WHEN substr(md5(invoice_id), 1, 1) <> '0' THEN invoice_amount END AS invoice_amount, status
FROM invoices""",
    views=("invoices",),
)
def q_src_typed_cells(fx):
    folder = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    tables.save(_spoiled(fx.invoices, "invoices"), f"{folder}/invoices.csv", fmt="csv")
    typed = tables.typed_cells(tables.read_cells(fx.spark, f"{folder}/invoices.csv"), "invoices")
    return typed.select("invoice_id", "issue_date", "due_date", "invoice_amount", "status")


@register(
    "audit_append_once", "AU-1 / SNK-2",
    """SELECT action_id, invoice_id, action_type, action_date, strftime(action_date, '%Y-%m') AS action_month,
       CASE WHEN CAST(action_id AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS batch_id
FROM audit_actions""",
    views=("audit_actions",),
)
def q_audit_append_once(fx):
    """The action log appended in two batches, one of them three times."""
    path = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    odd = F.col("action_id").cast("long") % 2
    for batch in ("even", "odd", "even", "even"):
        rows = fx.audit_actions.where(odd == int(batch == "odd")).select(*[c for c in audit.ACTION_COLUMNS if c in fx.audit_actions.columns])
        audit.append_batch(rows, path, batch_id=batch)
    return fx.spark.read.parquet(path).select("action_id", "invoice_id", "action_type", "action_date", "action_month", "batch_id")


# Ranges of days (NULL: open) and types (NULL: all): single days, overlaps, the whole log, none at all.
_RANGES = [
    (1, None, None, None), (2, "2024-01-01", "2024-01-31", None), (3, "2024-01-10", "2024-01-10", None), (4, None, "2024-01-15", "call_request"),
    (5, "2024-01-05", None, "payment_plan"), (6, "2024-01-05", "2024-01-25", None), (7, "2024-01-05", "2024-01-25", "escalate"),
    (8, "2030-01-01", None, None), (9, "2024-01-20", "2024-01-01", None), (10, "2024-01-02", "2024-03-31", "second_notice"),
]


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'"


@register(
    "success_by_ranges", "AU-5",
    f"""WITH ranges AS (
  SELECT CAST(r AS INTEGER) AS range_id, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b, k
  FROM (VALUES {", ".join(f"({r}, {_sql(a)}, {_sql(b)}, {_sql(k)})" for r, a, b, k in _RANGES)}) v(r, a, b, k)),
{PAIRS},
picked AS (
  SELECT DISTINCT range_id, action_id FROM ranges JOIN audit_actions ON (a IS NULL OR CAST(action_date AS DATE) >= a)
    AND (b IS NULL OR CAST(action_date AS DATE) <= b) AND (k IS NULL OR action_type = k)),
n AS (SELECT range_id, count(*) AS everyone, count(*) FILTER (WHERE action_id IN (SELECT action_id FROM audit_outcomes WHERE outcome_type = 'paid')) AS winners,
             count(*) FILTER (WHERE action_id IN (SELECT action_id FROM audit_responses)) AS answered FROM picked GROUP BY range_id),
m AS (SELECT range_id, avg(days_to_payment) AS days, sum(money) AS money FROM pairs JOIN picked USING (action_id) GROUP BY range_id)
SELECT range_id, coalesce(everyone, 0) AS total_actions, coalesce(winners, 0) AS successful_actions,
       coalesce({round_dec('CAST(winners AS double) / NULLIF(everyone, 0)', 6)}, 0.0) AS success_rate,
       coalesce({round_dec('CAST(answered AS double) / NULLIF(everyone, 0)', 6)}, 0.0) AS response_rate,
       coalesce({round_dec('days', 6)}, 0.0) AS avg_days_to_payment, CAST(coalesce(money, 0) AS double) AS total_amount_collected
FROM ranges LEFT JOIN n USING (range_id) LEFT JOIN m USING (range_id)""",
    views=("audit_actions", "audit_responses", "audit_outcomes"),
)
def q_success_by_ranges(fx):
    day = lambda v: None if v is None else dt.date.fromisoformat(v)
    ranges = fx.spark.createDataFrame([(r, day(a), day(b), k) for r, a, b, k in _RANGES], "range_id int, first_day date, last_day date, kind string")
    return activity.range_metrics(activity.activity_days(fx.audit_actions, fx.audit_responses, fx.audit_outcomes), ranges)


@register("daily_metrics_stream", "AU-8", REGISTRY["daily_success_metrics"].body, views=REGISTRY["daily_success_metrics"].views)
def q_daily_metrics_stream(fx):
    """The log fed to the stream in two halves, outcomes first, with a restart between."""
    folder = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("action_id"), F.lit(2))
    for n in (0, 1):
        outcomes = fx.audit_outcomes.where(half == 1 - n)
        tables.save(outcomes.select(*[c.split()[0] for c in daily_metrics.OUTCOME_EVENTS.split(", ")]), f"{folder}/outcomes", mode="append")
        tables.save(fx.audit_actions.where(half == n).select("action_id", "action_type", "action_date"), f"{folder}/actions", mode="append")
        daily_metrics.start(fx.spark, f"{folder}/actions", f"{folder}/outcomes", f"{folder}/changes").awaitTermination()
    return daily_metrics.current(fx.spark.read.schema(daily_metrics.CHANGES).parquet(f"{folder}/changes"))
