"""Testdata -> receivables views.

The driver's testdata is a TPC-H-like star schema. The view definitions below (one SQL each, written to run
unchanged in Spark SQL and DuckDB) turn it into the receivables tables the operators consume. Spark gets them as
lazy DataFrames through ``spark.sql(text, **frames)`` (no global temp views); the oracle side gets the same text as
``WITH`` clauses.

All views are plain projections / equi-joins of the base tables, so their size grows linearly with the testdata.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# The testdata table schemas. Reading with an explicit schema skips the footer-inference job that
# ``spark.read.parquet`` would otherwise launch for every table of every query.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_ACTION_INVOICE_KEY = (
    "event_id - CASE WHEN event_id % 20 < 7 THEN event_id % 20 WHEN event_id % 20 < 10 THEN event_id % 20 - 7 "
    "WHEN event_id % 20 < 12 THEN event_id % 20 - 10 ELSE 0 END"
)

# View SQL in dependency order. ``{name}`` marks a reference to another table or view.
VIEW_SQL: dict[str, str] = {
    "customers": """
SELECT concat('CUST-', lpad(cast(c_custkey AS string), 7, '0')) AS customer_id,
       c_name AS name,
       concat('ap', cast(c_custkey AS string), '@example.com') AS email,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('555-', lpad(cast(c_custkey AS string), 7, '0')) END AS phone,
       c_mktsegment AS industry,
       upper(substr(n_name, 1, 2)) AS country,
       CAST(NULL AS string) AS state,
       CASE c_custkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 45 ELSE 60 END AS payment_terms_days,
       round(abs(c_acctbal) * 500, 2) AS credit_limit,
       DATE '1994-01-01' AS created_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "invoices": """
SELECT concat('INV-', lpad(cast(o_orderkey AS string), 9, '0')) AS invoice_id,
       concat('CUST-', lpad(cast(o_custkey AS string), 7, '0')) AS customer_id,
       CAST(o_orderdate AS DATE) AS issue_date,
       CAST(o_orderdate AS DATE) + CAST(CASE o_custkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 45 ELSE 60 END AS int) AS due_date,
       o_totalprice AS invoice_amount,
       'USD' AS currency,
       CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'open'
            WHEN o_orderkey % 10 = 0 THEN 'cancelled' WHEN o_orderkey % 10 = 1 THEN 'void' ELSE 'open' END AS status,
       CASE o_orderkey % 4 WHEN 0 THEN 'one_time' WHEN 1 THEN 'recurring' WHEN 2 THEN 'milestone' ELSE 'retainer' END AS invoice_type,
       CASE WHEN o_orderkey % 2 = 0 THEN 'online' ELSE 'offline' END AS channel,
       CAST(o_orderdate AS DATE) AS created_at,
       o_orderkey
FROM {orders}""",
    "payments": """
SELECT concat('PAY-', lpad(cast(o_orderkey AS string), 9, '0'), '-', cast(part AS string)) AS payment_id,
       invoice_id,
       due_date + CAST((o_orderkey * 37) % 66 - 20 + 9 * (part - 1) AS int) AS payment_date,
       CASE WHEN status = 'paid' THEN invoice_amount ELSE CAST(round(CAST(invoice_amount AS decimal(18,4)) * 0.25, 2) AS double) END AS amount,
       CASE o_orderkey % 5 WHEN 0 THEN 'bank_transfer' WHEN 1 THEN 'ach' WHEN 2 THEN 'credit_card' WHEN 3 THEN 'check' ELSE 'wire' END AS method,
       CASE WHEN o_orderkey % 50 = 7 THEN 'failed' ELSE 'completed' END AS status
FROM {invoices} CROSS JOIN (SELECT 1 AS part UNION ALL SELECT 2 AS part) p
WHERE (status = 'paid' AND part = 1) OR (status = 'open' AND o_orderkey % 10 >= 7)""",
    "invoices_nulls": """
SELECT invoice_id, CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE customer_id END AS customer_id,
       CASE WHEN o_orderkey % 23 = 5 THEN NULL ELSE issue_date END AS issue_date,
       CASE WHEN o_orderkey % 19 = 4 THEN NULL ELSE due_date END AS due_date, invoice_amount, currency,
       CASE WHEN o_orderkey % 29 = 6 THEN NULL ELSE status END AS status, invoice_type, channel, created_at, o_orderkey
FROM {invoices}""",
    "payments_nulls": """
SELECT payment_id, invoice_id, CASE WHEN k % 13 = 5 THEN NULL ELSE payment_date END AS payment_date, amount, method, status
FROM (SELECT *, CAST(substr(invoice_id, 5) AS bigint) AS k FROM {payments}) p""",
    "audit_actions": f"""
SELECT cast(event_id AS string) AS action_id,
       concat('INV-', lpad(cast({_ACTION_INVOICE_KEY} AS string), 9, '0')) AS invoice_id,
       concat('CUST-', lpad(cast(o_custkey AS string), 7, '0')) AS customer_id,
       CASE event_type WHEN 'click' THEN 'friendly_reminder' WHEN 'view' THEN 'second_notice'
            WHEN 'signup' THEN 'call_request' WHEN 'purchase' THEN 'payment_plan' ELSE 'escalate' END AS action_type,
       ts AS action_date,
       CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' ELSE 'phone' END AS channel,
       'system' AS sent_by,
       props AS notes
FROM {{events}} JOIN {{orders}} ON o_orderkey = {_ACTION_INVOICE_KEY}""",
    "audit_responses": """
SELECT cast(event_id * 2 + k AS string) AS response_id, cast(event_id AS string) AS action_id, ts AS response_date,
       CASE event_id % 2 WHEN 0 THEN 'email' ELSE 'call' END AS response_type,
       event_id % 4 = 0 AS payment_promised
FROM {events} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) r
WHERE (event_id % 3 = 0 AND k = 0) OR (event_id % 9 = 0 AND k = 1)""",
    "audit_outcomes": f"""
SELECT cast(event_id AS string) AS outcome_id,
       concat('INV-', lpad(cast({_ACTION_INVOICE_KEY} AS string), 9, '0')) AS invoice_id,
       CASE WHEN event_id % 35 = 0 THEN NULL WHEN event_id % 55 = 0 THEN concat('lost-', cast(event_id AS string))
            ELSE cast(event_id AS string) END AS action_id,
       CASE WHEN event_id % 10 < 7 THEN 'paid' ELSE 'partial' END AS outcome_type,
       ts AS outcome_date, value AS amount_collected, CAST(event_id % 45 AS int) AS days_to_payment
FROM {{events}} WHERE event_id % 5 = 0""",
    "transactions": """
SELECT CASE WHEN l_returnflag = 'R' THEN concat('C', cast(l_orderkey AS string)) ELSE cast(l_orderkey AS string) END AS invoice_no,
       l_partkey AS stock_code, l_linenumber AS line_no, l_quantity AS quantity,
       l_extendedprice / l_quantity AS unit_price, o_orderdate AS invoice_date,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS customer_key,
       n_name AS country
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey""",
    "customers_dirty": """
SELECT CASE WHEN c_key % 131 = 5 THEN 'CUST-0000000' ELSE customer_id END AS customer_id, name,
       CASE WHEN c_key % 50 = 1 THEN 'not-an-email' WHEN c_key % 50 = 2 THEN NULL ELSE email END AS email,
       phone, industry,
       CASE WHEN c_key % 70 = 2 THEN 'USA' ELSE country END AS country, state,
       CASE WHEN c_key % 90 = 3 THEN 400 ELSE payment_terms_days END AS payment_terms_days,
       CASE WHEN c_key % 110 = 4 THEN -1.0 ELSE credit_limit END AS credit_limit, created_at
FROM (SELECT *, CAST(substr(customer_id, 6) AS int) AS c_key FROM {customers}) c""",
    "invoices_dirty": """
SELECT CASE WHEN o_orderkey % 997 = 3 THEN 'INV-000000000' ELSE invoice_id END AS invoice_id,
       CASE WHEN o_orderkey % 503 = 1 THEN 'CUST-9999999' ELSE customer_id END AS customer_id,
       issue_date,
       CASE WHEN o_orderkey % 401 = 2 THEN issue_date + CAST(-5 AS int) ELSE due_date END AS due_date,
       CASE WHEN o_orderkey % 307 = 4 THEN -invoice_amount ELSE invoice_amount END AS invoice_amount,
       CASE WHEN o_orderkey % 211 = 5 THEN 'US' ELSE currency END AS currency,
       CASE WHEN o_orderkey % 101 = 6 THEN ' OPEN ' WHEN o_orderkey % 103 = 7 THEN 'unknown' ELSE status END AS status,
       invoice_type, channel,
       CASE WHEN o_orderkey % 89 = 8 THEN issue_date + CAST(-1 AS int) ELSE created_at END AS created_at
FROM {invoices}""",
    "payments_dirty": """
SELECT CASE WHEN k % 499 = 9 THEN 'PAY-000000000-1' ELSE payment_id END AS payment_id,
       CASE WHEN k % 401 = 3 THEN 'INV-999999999' ELSE invoice_id END AS invoice_id, payment_date,
       CASE WHEN k % 61 = 2 THEN amount * 2 WHEN k % 307 = 5 THEN 0.0 ELSE amount END AS amount,
       CASE WHEN k % 211 = 4 THEN 'bitcoin' ELSE method END AS method, status
FROM (SELECT *, CAST(substr(invoice_id, 5) AS bigint) AS k FROM {payments}) p""",
    "raw_dates": """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 7 WHEN 0 THEN iso WHEN 1 THEN replace(iso, '-', '/')
            WHEN 2 THEN concat(substr(iso, 9, 2), '-', substr(iso, 6, 2), '-', substr(iso, 1, 4))
            WHEN 3 THEN concat(substr(iso, 9, 2), '/', substr(iso, 6, 2), '/', substr(iso, 1, 4))
            WHEN 4 THEN concat(iso, ' 10:20:30') WHEN 5 THEN concat(iso, 'T10:20:30') ELSE 'not a date' END AS raw_date
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS string) AS iso FROM {orders}) o""",
    "csv_actions": """
SELECT concat('ACT-', lpad(action_id, 8, '0')) AS action_id, invoice_id,
       CASE action_type WHEN 'friendly_reminder' THEN 'reminder1' WHEN 'second_notice' THEN 'reminder2'
            WHEN 'call_request' THEN 'call' WHEN 'payment_plan' THEN 'payment_plan' ELSE 'escalate' END AS action_type,
       action_date, notes, 'pending' AS outcome
FROM {audit_actions}""",
}

_REF = re.compile(r"\{([a-z_]+)\}")


def view_deps(name: str) -> list[str]:
    return _REF.findall(VIEW_SQL[name])


def duckdb_with(names: list[str]) -> str:
    """``WITH`` prefix (dependency closure of ``names``, in order) for a DuckDB oracle query."""
    need: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in need:
            return
        for d in view_deps(n):
            visit(d)
        need.append(n)

    for n in names:
        visit(n)
    if not need:
        return ""
    parts = [f"{n} AS ({_REF.sub(lambda m: m.group(1), VIEW_SQL[n]).strip()})" for n in need]
    return "WITH " + ",\n".join(parts) + "\n"


class Fixtures:
    """Lazy receivables views over one testdata directory.

    Every attribute is a DataFrame built on first use; nothing is collected. Base tables are read with
    ``spark.read.parquet`` so column pruning and filter pushdown reach the scan. Use :meth:`of` to share the analysed
    views between the queries of one session (DataFrames are immutable plans, so sharing is safe).
    """

    _shared: dict[tuple[int, str], "Fixtures"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Fixtures":
        key = (id(spark), sf_dir.rstrip("/"))
        fx = cls._shared.get(key)
        if fx is None or fx.spark is not spark:
            fx = cls._shared[key] = cls(spark, sf_dir)
        return fx

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                df = self.spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                deps = {d: self.table(d) for d in view_deps(name)}
                df = self.spark.sql(VIEW_SQL[name], **deps)
            self._frames[name] = df
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEW_SQL and name not in BASE_TABLES):
            raise AttributeError(name)
        return self.table(name)

