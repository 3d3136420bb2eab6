"""Registered queries: what the loaders and writers keep (SRC-4..6, SRC-8, SNK-1..4), DQ-1, AU-2 and OU-7, by round trip."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from receivables.operators import aging, audit, features, metrics, outreach, quality, reports
from receivables.plans.catalog import AS_OF, REGISTRY, register
from receivables.plans.reg_data import FK_PAY_SQL, INV_ROWS_SQL, OVERPAY_SQL, PAY_ROWS_SQL
from receivables.session import ensure_checkpoint_dir
from receivables.sources import layout, tables, workbook


def _folder(fx, name: str) -> str:
    return f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("src_actions", "SRC-4", "SELECT action_id, invoice_id, action_type, date_trunc('second', action_date) AS action_date, notes, outcome FROM csv_actions", views=("csv_actions",))
def q_src_actions(fx):
    folder = _folder(fx, "actions")
    dated = fx.csv_actions.withColumn("action_date", F.date_format("action_date", "yyyy-MM-dd HH:mm:ss"))
    tables.save(dated.select("outcome", "notes", "action_date", "action_type", "invoice_id", "action_id"), f"{folder}/actions.csv", fmt="csv")
    return tables.DataLoader(fx.spark, folder).load_actions()


@register(
    "src_load_all", "SRC-5 / SRC-6",
    """SELECT 'customers' AS "table", count(*) AS n, count(DISTINCT customer_id) AS keys FROM customers
UNION ALL SELECT 'invoices', count(*), count(DISTINCT invoice_id) FROM invoices
UNION ALL SELECT 'payments', count(*), count(DISTINCT payment_id) FROM payments UNION ALL SELECT 'actions', 0, 0""",
    views=("customers", "invoices", "payments"),
)
def q_src_load_all(fx):
    """CSV and parquet next to each other, and no actions file."""
    folder = _folder(fx, "all")
    for name, fmt in (("customers", "csv"), ("invoices", "parquet"), ("payments", "csv")):
        tables.save(fx.table(name).select(*tables.column_types(name)), f"{folder}/{name}.{fmt}", fmt=fmt)
    loaded = zip(("customers", "invoices", "payments", "actions"), tables.DataLoader(fx.spark, folder).load_all(validate=False))
    keys = quality.KEYS
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), F.count_distinct(keys[name]).alias("keys")) for name, df in loaded]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("src_schedule", "SRC-8 / SNK-1", f"SELECT invoice_id, attempt_number, action_type, scheduled_date, status FROM ({REGISTRY['schedule'].body}) s", views=REGISTRY["schedule"].views)
def q_src_schedule(fx):
    """The schedule saved as CSV and read again."""
    folder = _folder(fx, "schedule")
    tables.save(REGISTRY["schedule"].build(fx), f"{folder}/schedule.csv", fmt="csv")
    return tables.read_schedule(fx.spark, f"{folder}/schedule.csv").select("invoice_id", "attempt_number", "action_type", "scheduled_date", "status")


@register("snk_partitioned", "SNK-1 / SNK-3", "SELECT invoice_id, invoice_amount, issue_date, status FROM invoices", views=("invoices",))
def q_snk_partitioned(fx):
    """Parquet partitioned by status, rewritten as JSON, and read back."""
    folder = _folder(fx, "sink")
    tables.save(fx.invoices.select("invoice_id", "invoice_amount", "issue_date", "status"), f"{folder}/p", partition_by=["status"])
    back = fx.spark.read.parquet(f"{folder}/p")
    tables.save(back, f"{folder}/j", fmt="json")
    return fx.spark.read.schema("invoice_id string, invoice_amount double, issue_date date, status string").json(f"{folder}/j")


@register("snk_report", "SNK-4", f"SELECT '2001-06-30' AS as_of, a.* FROM ({REGISTRY['aging_summary'].body}) a", views=REGISTRY["aging_summary"].views)
def q_snk_report(fx):
    """The JSON report written and read again; its aging rows."""
    folder = _folder(fx, "report")
    summary = aging.aging_summary(fx.invoices, AS_OF)
    tables.save(tables.report(metrics.ar_summary(fx.invoices, fx.payments, AS_OF), summary, AS_OF), f"{folder}/report", fmt="json")
    row = "array<struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in summary.schema) + ">>"
    found = fx.spark.read.schema(f"as_of string, aging_summary {row}").json(f"{folder}/report")
    return found.select("as_of", F.explode("aging_summary").alias("a")).select("as_of", "a.*")


@register(
    "dq_missing_columns", "DQ-1",
    f"""SELECT 'customers' AS "table", 'missing_columns' AS rule, CAST(1 AS BIGINT) AS n
UNION ALL SELECT "table", rule, count(*) FROM ({INV_ROWS_SQL}) i GROUP BY 1, 2
UNION ALL SELECT "table", rule, count(*) FROM ({PAY_ROWS_SQL}) p GROUP BY 1, 2
UNION ALL SELECT "table", rule, count(*) FROM ({FK_PAY_SQL}) f GROUP BY 1, 2
UNION ALL SELECT "table", rule, count(*) FROM ({OVERPAY_SQL}) o GROUP BY 1, 2""",
    views=("customers_dirty", "invoices_dirty", "payments_dirty"),
)
def q_dq_missing_columns(fx):
    """Customers without two required columns: one row for them, none of their other rules; the other tables as ever."""
    found = quality.validate_all(fx.customers_dirty.drop("email", "country"), fx.invoices_dirty, fx.payments_dirty)
    rules = ~F.col("rule").isin("duplicate_key", "due_before_issue", "created_before_issue")
    return found.where(rules).groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))


@register(
    "csv_actions_logged", "AU-2",
    """SELECT invoice_id, action_type, outcome, notes, CAST(length(action_id) AS INTEGER) AS id_length FROM csv_actions
UNION ALL SELECT invoice_id, 'reminder1', 'pending', 'sent', 36 FROM invoices WHERE status = 'open'""",
    views=("csv_actions", "invoices"),
)
def q_csv_actions_logged(fx):
    new = audit.new_csv_actions(fx.invoices.where(F.col("status") == "open"), "reminder1", AS_OF, "sent")
    return audit.append_actions(fx.csv_actions, new).select("invoice_id", "action_type", "outcome", "notes", F.length("action_id").alias("id_length"))


@register(
    "outreach_logged", "OU-7 / AU-1",
    f"""SELECT invoice_id, customer_id, action_type, 'email' AS channel, email_body AS message_sent, 'system' AS sent_by,
       'Generated by CLI - Risk: unknown' AS notes, '2001-06' AS action_month FROM ({REGISTRY['outreach_messages'].body}) m""",
    views=REGISTRY["outreach_messages"].views,
)
def q_outreach_logged(fx):
    """The messages logged twice as one batch."""
    path = _folder(fx, "outreach")
    rows = outreach.log_messages(REGISTRY["outreach_messages"].build(fx), dt.datetime(2001, 6, 30, 9))
    for _ in range(2):
        audit.append_batch(rows, path, batch_id="2001-06-30")
    return fx.spark.read.parquet(path).select("invoice_id", "customer_id", "action_type", "channel", "message_sent", "sent_by", "notes", "action_month")


def _bucketed(fx, table: str, key: str):
    name = f"{table}_{uuid.uuid4().hex}"
    return layout.save_bucketed(fx.table(table), name, key, 8, _folder(fx, name))


@register("late_target_bucketed", "FE-3 / SNK-1", REGISTRY["late_target"].body, views=REGISTRY["late_target"].views)
def q_late_target_bucketed(fx):
    """Invoices and payments bucketed by invoice: the join shuffles neither."""
    found = features.late_target(_bucketed(fx, "invoices", "invoice_id"), _bucketed(fx, "payments", "invoice_id"), 7)
    return found.select("invoice_id", "customer_id", "due_date", "payment_date", "days_late", "is_late")


@register("dq_overpayments_bucketed", "DQ-12 / SNK-1", OVERPAY_SQL, views=("invoices_dirty", "payments_dirty"))
def q_dq_overpayments_bucketed(fx):
    return quality.overpayments(_bucketed(fx, "payments_dirty", "invoice_id"), _bucketed(fx, "invoices_dirty", "invoice_id"))


# Terms that match one customer, a hundred, all, and none; two characters, and mixed case.
_TERMS = ["CUST-0000017", "St-00000", "cust-", "nobody", "42", "T-00001"]


@register(
    "invoice_search", "FN-12",
    " UNION ALL ".join(f"""SELECT '{t}' AS term, invoice_id, customer_id, invoice_amount, issue_date, due_date, status FROM invoices
WHERE status IN ('open', 'void') AND contains(lower(customer_id), '{t.lower()}') AND invoice_amount >= 1000""" for t in _TERMS),
    views=("invoices",),
)
def q_invoice_search(fx):
    """The explorer over rows found through posting lists of the customer ids."""
    folder = _folder(fx, "search")
    rows = fx.invoices.select("invoice_id", "customer_id", "invoice_amount", "issue_date", "due_date", "status")
    layout.save_searchable(rows, folder)
    out = None
    for term in _TERMS:
        found = reports.invoice_explorer(layout.search(fx.spark, folder, rows.schema, term), ("open", "void"), "", 1000).select(F.lit(term).alias("term"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@register(
    "src_workbook", "SRC-7",
    """SELECT invoice_no, CAST(stock_code AS VARCHAR) AS stock_code, CAST(quantity AS DOUBLE) AS quantity, unit_price,
       CAST(invoice_date AS TIMESTAMP) AS invoice_date, CAST(customer_key AS DOUBLE) AS customer_key, country FROM transactions""",
    views=("transactions",),
)
def q_src_workbook(fx):
    """Retail lines written as spreadsheets and read again."""
    folder = _folder(fx, "workbooks")
    columns = {"InvoiceNo": "invoice_no", "StockCode": "stock_code", "Quantity": "quantity", "InvoiceDate": "invoice_date", "UnitPrice": "unit_price", "CustomerID": "customer_key", "Country": "country"}
    workbook.save(fx.transactions.select(*[F.col(c).alias(name) for name, c in columns.items()]), folder)
    return tables.read_transactions(fx.spark, folder, fmt="workbook").drop("line_no")
