"""Registered queries: data quality (DQ-*) over the dirty fixture views, and ingest (ING-*) over transactions."""

from __future__ import annotations

import uuid

from receivables.operators import ingest, quality
from receivables.plans.catalog import register
from receivables.plans.sqlfrag import money2
from receivables.session import ensure_checkpoint_dir
from receivables.sources import tables

VD = ("customers_dirty", "invoices_dirty", "payments_dirty")


def _len(c: str, lo: int, hi: int) -> str:
    return f"(trim(CAST({c} AS VARCHAR)) IS NOT NULL AND length(trim(CAST({c} AS VARCHAR))) BETWEEN {lo} AND {hi})"


def _opt(c: str, hi: int) -> str:
    return f"(trim(CAST({c} AS VARCHAR)) IS NULL OR length(trim(CAST({c} AS VARCHAR))) <= {hi})"


def _enum(c: str, vals: list[str]) -> str:
    inner = ", ".join(f"'{v}'" for v in vals)
    return f"coalesce(lower(trim(CAST({c} AS VARCHAR))) IN ({inner}), false)"


CUSTOMER_OK = [
    ("customer_id", _len("customer_id", 1, 100)),
    ("name", _len("name", 1, 200)),
    ("email", f"coalesce(regexp_matches(trim(email), '{quality.EMAIL_PATTERN}'), false)"),
    ("phone", _opt("phone", 50)),
    ("industry", _opt("industry", 100)),
    ("country", _len("country", 2, 2)),
    ("state", _opt("state", 50)),
    ("payment_terms_days", "payment_terms_days BETWEEN 0 AND 365"),
    ("credit_limit", "credit_limit >= 0"),
    ("created_at", "created_at IS NOT NULL"),
]
INVOICE_OK = [
    ("invoice_id", _len("invoice_id", 1, 100)),
    ("customer_id", _len("customer_id", 1, 100)),
    ("issue_date", "issue_date IS NOT NULL"),
    ("due_date", "due_date IS NOT NULL"),
    ("invoice_amount", "invoice_amount > 0"),
    ("currency", _len("currency", 3, 3)),
    ("status", _enum("status", quality.INVOICE_STATUS)),
    ("invoice_type", _enum("invoice_type", quality.INVOICE_TYPE)),
    ("channel", _enum("channel", quality.CHANNEL)),
    ("created_at", "created_at IS NOT NULL"),
]
PAYMENT_OK = [
    ("payment_id", _len("payment_id", 1, 100)),
    ("invoice_id", _len("invoice_id", 1, 100)),
    ("payment_date", "payment_date IS NOT NULL"),
    ("amount", "amount > 0"),
    ("method", _enum("method", quality.PAYMENT_METHOD)),
    ("status", _enum("status", quality.PAYMENT_STATUS)),
]


def _rows_sql(table: str, src: str, key: str, checks) -> str:
    arr = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in checks)
    return f"""SELECT '{table}' AS "table", '{table}_row:' || r AS rule, 'error' AS severity, CAST(k AS VARCHAR) AS key,
       'invalid ' || r AS message
FROM (SELECT {key} AS k, unnest(list_filter([{arr}], lambda x: x IS NOT NULL)) AS r FROM {src}) q"""


def _dup_sql(table: str, src: str, key: str) -> str:
    return f"""SELECT '{table}' AS "table", 'duplicate_key' AS rule, 'error' AS severity, CAST({key} AS VARCHAR) AS key,
       'Duplicate {key}s found' AS message FROM {src} GROUP BY {key} HAVING count(*) > 1"""


def _all_ok(checks) -> str:
    return " AND ".join(f"coalesce({ok}, false)" for _, ok in checks)


DUP_SQL = " UNION ALL ".join([
    _dup_sql("customers", "customers_dirty", "customer_id"),
    _dup_sql("invoices", "invoices_dirty", "invoice_id"),
    _dup_sql("payments", "payments_dirty", "payment_id"),
])
CUST_ROWS_SQL = _rows_sql("customers", "customers_dirty", "customer_id", CUSTOMER_OK)
INV_ROWS_SQL = _rows_sql("invoices", "invoices_dirty", "invoice_id", INVOICE_OK)
PAY_ROWS_SQL = _rows_sql("payments", "payments_dirty", "payment_id", PAYMENT_OK)
FK_INV_SQL = """SELECT 'invoices' AS "table", 'fk_customer' AS rule, 'error' AS severity, CAST(customer_id AS VARCHAR) AS key,
       'Invoices reference non-existent customers' AS message
FROM (SELECT DISTINCT customer_id FROM invoices_dirty) i
WHERE NOT EXISTS (SELECT 1 FROM customers_dirty c WHERE c.customer_id = i.customer_id)"""
FK_PAY_SQL = """SELECT 'payments' AS "table", 'fk_invoice' AS rule, 'error' AS severity, CAST(invoice_id AS VARCHAR) AS key,
       'Payments reference non-existent invoices' AS message
FROM (SELECT DISTINCT invoice_id FROM payments_dirty) p
WHERE NOT EXISTS (SELECT 1 FROM invoices_dirty i WHERE i.invoice_id = p.invoice_id)"""
DUE_SQL = f"""SELECT 'invoices' AS "table", 'due_before_issue' AS rule, 'error' AS severity, invoice_id AS key,
       'Invoice ' || invoice_id || ': due_date before issue_date' AS message
FROM invoices_dirty WHERE {_all_ok(INVOICE_OK)} AND due_date < issue_date"""
CREATED_SQL = f"""SELECT 'invoices' AS "table", 'created_before_issue' AS rule, 'warning' AS severity, invoice_id AS key,
       'Invoice ' || invoice_id || ': created_at before issue_date' AS message
FROM invoices_dirty WHERE {_all_ok(INVOICE_OK)} AND created_at < issue_date"""
CONTACT_SQL = """SELECT 'customers' AS "table", 'missing_' || f AS rule, 'warning' AS severity, CAST(NULL AS VARCHAR) AS key,
       CAST(n AS VARCHAR) || ' customers missing ' || f AS message
FROM (SELECT 'email' AS f, count(*) FILTER (WHERE email IS NULL) AS n FROM customers_dirty
      UNION ALL SELECT 'phone', count(*) FILTER (WHERE phone IS NULL) FROM customers_dirty) q WHERE n > 0"""
OVERPAY_SQL = """SELECT 'payments' AS "table", 'overpayment' AS rule, 'warning' AS severity, p.invoice_id AS key,
       printf('Invoice %s: payments ($%.2f) exceed invoice amount ($%.2f)', p.invoice_id, paid, i.invoice_amount) AS message
FROM (SELECT invoice_id, CAST(sum(CAST(amount AS decimal(18,2))) AS double) AS paid FROM payments_dirty GROUP BY invoice_id) p
JOIN (SELECT invoice_id, min(invoice_amount) AS invoice_amount FROM invoices_dirty GROUP BY invoice_id) i ON p.invoice_id = i.invoice_id
WHERE paid > i.invoice_amount * 1.01"""


def _dirty(fx):
    return fx.customers_dirty, fx.invoices_dirty, fx.payments_dirty


@register("dq_duplicate_keys", "DQ-2", DUP_SQL, views=VD)
def q_dq_duplicate_keys(fx):
    return quality.duplicate_keys(*_dirty(fx))


@register("dq_customer_rows", "DQ-3", CUST_ROWS_SQL, views=("customers_dirty",))
def q_dq_customer_rows(fx):
    return quality.customer_rows(fx.customers_dirty)


@register("dq_invoice_rows", "DQ-4", INV_ROWS_SQL, views=("invoices_dirty",))
def q_dq_invoice_rows(fx):
    return quality.invoice_rows(fx.invoices_dirty)


@register("dq_payment_rows", "DQ-5", PAY_ROWS_SQL, views=("payments_dirty",))
def q_dq_payment_rows(fx):
    return quality.payment_rows(fx.payments_dirty)


@register("dq_fk_invoices", "DQ-7", FK_INV_SQL, views=("customers_dirty", "invoices_dirty"))
def q_dq_fk_invoices(fx):
    return quality.fk_invoices(fx.invoices_dirty, fx.customers_dirty)


@register("dq_fk_payments", "DQ-8", FK_PAY_SQL, views=("invoices_dirty", "payments_dirty"))
def q_dq_fk_payments(fx):
    return quality.fk_payments(fx.payments_dirty, fx.invoices_dirty)


@register("dq_due_before_issue", "DQ-9", DUE_SQL, views=("invoices_dirty",))
def q_dq_due_before_issue(fx):
    return quality.due_before_issue(fx.invoices_dirty)


@register("dq_created_before_issue", "DQ-10", CREATED_SQL, views=("invoices_dirty",))
def q_dq_created_before_issue(fx):
    return quality.created_before_issue(fx.invoices_dirty)


@register("dq_missing_contacts", "DQ-11", CONTACT_SQL, views=("customers_dirty",))
def q_dq_missing_contacts(fx):
    return quality.missing_contacts(fx.customers_dirty)


@register("dq_overpayments", "DQ-12", OVERPAY_SQL, views=("invoices_dirty", "payments_dirty"))
def q_dq_overpayments(fx):
    return quality.overpayments(fx.payments_dirty, fx.invoices_dirty)


ACTION_OK = [
    ("action_id", _len("action_id", 1, 100)),
    ("invoice_id", _len("invoice_id", 1, 100)),
    ("action_type", _enum("action_type", quality.ACTION_TYPE)),
    ("action_date", "action_date IS NOT NULL"),
    ("notes", _opt("notes", 1000)),
    ("outcome", _enum("outcome", quality.ACTION_OUTCOME)),
]


@register("dq_action_rows", "DQ-6", _rows_sql("actions", "csv_actions", "action_id", ACTION_OK), views=("csv_actions",))
def q_dq_action_rows(fx):
    return quality.action_rows(fx.csv_actions)


ALL_V_SQL = " UNION ALL ".join(
    f"SELECT * FROM ({s}) x{i}"
    for i, s in enumerate([DUP_SQL, CUST_ROWS_SQL, CONTACT_SQL, INV_ROWS_SQL, FK_INV_SQL, DUE_SQL, CREATED_SQL,
                           PAY_ROWS_SQL, FK_PAY_SQL, OVERPAY_SQL])
)


@register(
    "dq_summary", "DQ-13",
    f"""WITH v AS ({ALL_V_SQL}),
c AS (SELECT 'customers' AS "table", count(*) AS row_count FROM customers_dirty
      UNION ALL SELECT 'invoices', count(*) FROM invoices_dirty UNION ALL SELECT 'payments', count(*) FROM payments_dirty),
g AS (SELECT "table", count(*) FILTER (WHERE severity = 'error') AS errors,
             count(*) FILTER (WHERE severity = 'warning') AS warnings FROM v GROUP BY "table")
SELECT c."table", row_count, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS is_valid
FROM c LEFT JOIN g ON c."table" = g."table" """,
    views=VD,
)
def q_dq_summary(fx):
    c, i, p = _dirty(fx)
    v = quality.validate_all(c, i, p)
    return quality.summary(v, {"customers": c, "invoices": i, "payments": p})


@register(
    "dq_parse_dates", "DQ-14",
    """SELECT row_id, raw_date, p AS parsed, p IS NOT NULL AS is_valid FROM (
  SELECT row_id, raw_date, coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%Y/%m/%d'),
         try_strptime(raw_date, '%d-%m-%Y'), try_strptime(raw_date, '%d/%m/%Y'),
         try_strptime(raw_date, '%Y-%m-%d %H:%M:%S'), try_strptime(raw_date, '%Y-%m-%dT%H:%M:%S')) AS p
  FROM raw_dates) q""",
    views=("raw_dates",),
)
def q_dq_parse_dates(fx):
    return quality.parse_dates(fx.raw_dates)


CLEAN_SQL = """SELECT *, quantity * unit_price AS amount FROM transactions
WHERE NOT starts_with(CAST(invoice_no AS VARCHAR), 'C') AND customer_key IS NOT NULL AND quantity > 0 AND unit_price > 0"""


@register("ing_clean_transactions", "ING-1", CLEAN_SQL, views=("transactions",))
def q_ing_clean(fx):
    return ingest.clean_transactions(fx.transactions)


def _case_map(c: str, d: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {c} {whens} ELSE '{default}' END"


def _zfill(c: str, w: int) -> str:
    return f"CASE WHEN length({c}) >= {w} THEN {c} ELSE lpad({c}, {w}, '0') END"


ING_CUST_SQL = f"""SELECT 'CUST-' || {_zfill('k', 5)} AS customer_id, 'Customer ' || k AS name,
       lower('CUST-' || {_zfill('k', 5)}) || '@company.com' AS email, CAST(NULL AS VARCHAR) AS phone,
       {_case_map('country_name', ingest.INDUSTRY_BY_COUNTRY, ingest.DEFAULT_INDUSTRY)} AS industry,
       {_case_map('country_name', ingest.CODE_BY_COUNTRY, ingest.DEFAULT_CODE)} AS country,
       CAST(NULL AS VARCHAR) AS state,
       CASE WHEN lifetime > 50000 THEN 60 WHEN lifetime > 20000 THEN 45 ELSE 30 END AS payment_terms_days,
       {money2('lifetime * 2')} AS credit_limit, strftime(first_date, '%Y-%m-%d') AS created_at, customer_key AS source_key
FROM (SELECT customer_key, CAST(CAST(customer_key AS BIGINT) AS VARCHAR) AS k,
             first(country ORDER BY invoice_date, invoice_no, line_no) AS country_name,
             min(invoice_date) AS first_date, sum(amount) AS lifetime
      FROM ({CLEAN_SQL}) c GROUP BY customer_key) g"""


@register("ing_customers", "ING-2", ING_CUST_SQL, views=("transactions",))
def q_ing_customers(fx):
    return ingest.build_customers(ingest.clean_transactions(fx.transactions))


@register(
    "ing_invoices", "ING-3",
    f"""SELECT 'INV-' || {_zfill('CAST(invoice_no AS VARCHAR)', 6)} AS invoice_id, c.customer_id,
       CAST(invoice_date AS DATE) AS issue_date,
       CAST(invoice_date AS DATE) + CAST(coalesce(c.payment_terms_days, 30) AS int) AS due_date,
       {money2('total')} AS invoice_amount, 'GBP' AS currency, 'open' AS status, 'one_time' AS invoice_type,
       'online' AS channel, CAST(invoice_date AS DATE) AS created_at
FROM (SELECT invoice_no, first(customer_key ORDER BY invoice_date, invoice_no, line_no) AS customer_key,
             first(invoice_date ORDER BY invoice_date, invoice_no, line_no) AS invoice_date, sum(amount) AS total
      FROM ({CLEAN_SQL}) t GROUP BY invoice_no) g
JOIN ({ING_CUST_SQL}) c ON g.customer_key = c.source_key""",
    views=("transactions",),
)
def q_ing_invoices(fx):
    clean = ingest.clean_transactions(fx.transactions)
    return ingest.build_invoices(clean, ingest.build_customers(clean))


# SRC-1..3: the fixture tables written as CSV with their columns in another order, and loaded again by DataLoader.
def _loaded(fx, name: str):
    folder = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/sources-{uuid.uuid4().hex}"
    columns = reversed(tables.column_types(name))
    tables.save(fx.table(name).select(*columns), f"{folder}/{name}.csv", fmt="csv")
    return getattr(tables.DataLoader(fx.spark, folder), f"load_{name}")()


def _columns(name: str) -> str:
    return ", ".join(tables.column_types(name))


@register("src_customers", "SRC-1", f"SELECT {_columns('customers')} FROM customers", views=("customers",))
def q_src_customers(fx):
    return _loaded(fx, "customers")


@register("src_invoices", "SRC-2", f"SELECT {_columns('invoices')} FROM invoices", views=("invoices",))
def q_src_invoices(fx):
    return _loaded(fx, "invoices")


@register("src_payments", "SRC-3", f"SELECT {_columns('payments')} FROM payments", views=("payments",))
def q_src_payments(fx):
    return _loaded(fx, "payments")
