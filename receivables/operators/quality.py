"""Set-based data quality (DQ-*): every rule emits rows of ``violations(table, rule, severity, key, message)``.

A run is valid when no ``error`` row exists. Row rules are one projection per table (an array of failed rule names,
exploded), key rules are ``groupBy`` / ``left_anti`` joins, so validation is a handful of scans whatever the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.functions import dates

VIOLATION_SCHEMA = "table string, rule string, severity string, key string, message string"

# Enum domains (values are lower-cased and stripped before the check).
INVOICE_STATUS = ["open", "paid", "void", "cancelled"]
INVOICE_TYPE = ["one_time", "recurring", "milestone", "retainer"]
CHANNEL = ["online", "offline", "both"]
PAYMENT_METHOD = ["bank_transfer", "credit_card", "check", "cash", "wire", "ach", "other"]
PAYMENT_STATUS = ["pending", "completed", "failed", "refunded"]
ACTION_TYPE = [
    "reminder1", "reminder2", "reminder3", "call", "email_friendly", "email_firm", "email_final", "payment_plan",
    "pause_service", "escalate", "legal",
]
ACTION_OUTCOME = ["pending", "success", "no_response", "dispute", "promise_to_pay", "payment_plan_accepted"]
# Fixed value: the email pattern.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# The columns that a table must have.
REQUIRED = {
    "customers": ["customer_id", "name", "email", "country", "payment_terms_days", "credit_limit", "created_at"],
    "invoices": ["invoice_id", "customer_id", "issue_date", "due_date", "invoice_amount", "currency", "status",
                 "invoice_type", "channel", "created_at"],
    "payments": ["payment_id", "invoice_id", "payment_date", "amount", "method", "status"],
    "actions": ["action_id", "invoice_id", "action_type", "action_date", "notes", "outcome"],
}


def _v(df: DataFrame, table: str, rule: Column | str, severity: str, key: Column | str, message: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.lit(table).alias("table"), lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), lit(message).alias("message"),
    )


def missing_columns(df: DataFrame, table: str) -> list[str]:
    """DQ-1: required columns absent from ``df`` (a schema check on the driver; no data is read)."""
    return sorted(set(REQUIRED[table]) - set(df.columns))


def _str(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def _len_between(c: str, lo: int, hi: int) -> Column:
    s = _str(c)
    return s.isNotNull() & (F.length(s) >= lo) & (F.length(s) <= hi)


def _opt_len(c: str, hi: int) -> Column:
    s = _str(c)
    return s.isNull() | (F.length(s) <= hi)


def _enum(c: str, values: list[str]) -> Column:
    return F.coalesce(F.lower(_str(c)).isin(values), F.lit(False))


def _date_ok(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType.simpleString()
    if t in ("date", "timestamp", "timestamp_ntz"):
        return F.col(c).isNotNull()
    return dates.parse_date(F.col(c)).isNotNull()


def _row_rules(df: DataFrame, table: str, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())
    x = df.select(F.col(key).alias("__k"), F.explode(failed).alias("__rule"))
    return _v(x, table, F.concat(F.lit(f"{table}_row:"), F.col("__rule")), "error", "__k",
              F.concat(F.lit("invalid "), F.col("__rule")))


def _dup_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    d = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _v(d, table, "duplicate_key", "error", key, F.lit(f"Duplicate {key}s found"))


def customer_checks(df: DataFrame) -> list[tuple[str, Column]]:
    return [
        ("customer_id", _len_between("customer_id", 1, 100)),
        ("name", _len_between("name", 1, 200)),
        ("email", F.coalesce(_str("email").rlike(EMAIL_PATTERN), F.lit(False))),
        ("phone", _opt_len("phone", 50) if "phone" in df.columns else F.lit(True)),
        ("industry", _opt_len("industry", 100) if "industry" in df.columns else F.lit(True)),
        ("country", _len_between("country", 2, 2)),
        ("state", _opt_len("state", 50) if "state" in df.columns else F.lit(True)),
        ("payment_terms_days", F.col("payment_terms_days").between(0, 365)),
        ("credit_limit", F.col("credit_limit") >= 0),
        ("created_at", _date_ok(df, "created_at")),
    ]


def invoice_checks(df: DataFrame) -> list[tuple[str, Column]]:
    return [
        ("invoice_id", _len_between("invoice_id", 1, 100)),
        ("customer_id", _len_between("customer_id", 1, 100)),
        ("issue_date", _date_ok(df, "issue_date")),
        ("due_date", _date_ok(df, "due_date")),
        ("invoice_amount", F.col("invoice_amount") > 0),
        ("currency", _len_between("currency", 3, 3) if "currency" in df.columns else F.lit(True)),
        ("status", _enum("status", INVOICE_STATUS)),
        ("invoice_type", _enum("invoice_type", INVOICE_TYPE)),
        ("channel", _enum("channel", CHANNEL)),
        ("created_at", _date_ok(df, "created_at")),
    ]


def payment_checks(df: DataFrame) -> list[tuple[str, Column]]:
    return [
        ("payment_id", _len_between("payment_id", 1, 100)),
        ("invoice_id", _len_between("invoice_id", 1, 100)),
        ("payment_date", _date_ok(df, "payment_date")),
        ("amount", F.col("amount") > 0),
        ("method", _enum("method", PAYMENT_METHOD)),
        ("status", _enum("status", PAYMENT_STATUS)),
    ]


def action_checks(df: DataFrame) -> list[tuple[str, Column]]:
    return [
        ("action_id", _len_between("action_id", 1, 100)),
        ("invoice_id", _len_between("invoice_id", 1, 100)),
        ("action_type", _enum("action_type", ACTION_TYPE)),
        ("action_date", _date_ok(df, "action_date")),
        ("notes", _opt_len("notes", 1000)),
        ("outcome", _enum("outcome", ACTION_OUTCOME)),
    ]


def duplicate_keys(customers: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """DQ-2: duplicate primary keys of the three tables (one row per duplicated id)."""
    return _dup_keys(customers, "customers", "customer_id").unionByName(
        _dup_keys(invoices, "invoices", "invoice_id")).unionByName(_dup_keys(payments, "payments", "payment_id"))


def customer_rows(customers: DataFrame) -> DataFrame:
    """DQ-3: per-row customer rules (one violation per failed field)."""
    return _row_rules(customers, "customers", "customer_id", customer_checks(customers))


def invoice_rows(invoices: DataFrame) -> DataFrame:
    """DQ-4: per-row invoice rules."""
    return _row_rules(invoices, "invoices", "invoice_id", invoice_checks(invoices))


def payment_rows(payments: DataFrame) -> DataFrame:
    """DQ-5: per-row payment rules."""
    return _row_rules(payments, "payments", "payment_id", payment_checks(payments))


def action_rows(actions: DataFrame) -> DataFrame:
    """DQ-6: per-row action rules (the reference defines them; its table validators never call them)."""
    return _row_rules(actions, "actions", "action_id", action_checks(actions))


CELL_SCHEMA = f"{VIOLATION_SCHEMA}, file string, raw string"
KEYS = {"customers": "customer_id", "invoices": "invoice_id", "payments": "payment_id", "actions": "action_id"}


def bad_cells(cells: DataFrame, table: str) -> DataFrame:
    """DQ-3..DQ-6 on the text of a CSV (``tables.read_cells``): a violation for every cell that holds a text but no value of
    its column, and for every line without the header's number of cells, with the file and the raw text.

    Rule ``unreadable:<column>`` or ``malformed_line`` (raw: the whole line; its cells are not judged). An empty cell is a
    missing value: the row rules report it where the column must not be empty.
    """
    from receivables.sources import tables

    types, days = tables.column_types(table), tables.DATE_COLUMNS.get(table, [])
    whole = F.col(tables.CELL_RECORD).isNull()
    item = lambda rule, raw, message: F.struct(F.lit(rule).alias("rule"), raw.alias("raw"), message.alias("message"))
    found = [F.when(~whole, item("malformed_line", F.col(tables.CELL_RECORD), F.lit("line does not have the header's columns")))]
    for c, t in types.items():
        if c in cells.columns and (t != "string" or c in days):
            raw = F.col(f"`{c}`")
            bad = whole & (F.trim(raw) != "") & tables.cell_value(c, t, c in days).isNull()
            found.append(F.when(bad, item(f"unreadable:{c}", raw, F.concat(F.lit(f"cannot read {c}: "), raw))))
    key = F.col(KEYS[table]) if KEYS[table] in cells.columns else F.lit(None).cast("string")
    x = cells.select(key.alias("key"), F.col(tables.CELL_FILE).alias("file"), F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("v"))
    return x.select(F.lit(table).alias("table"), F.col("v.rule").alias("rule"), F.lit("error").alias("severity"), "key", F.col("v.message").alias("message"), "file", F.col("v.raw").alias("raw"))


def fk_invoices(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """DQ-7: distinct invoice customer_ids with no customer row."""
    bad = invoices.select("customer_id").distinct().join(customers.select("customer_id"), "customer_id", "left_anti")
    return _v(bad, "invoices", "fk_customer", "error", "customer_id", F.lit("Invoices reference non-existent customers"))


def fk_payments(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """DQ-8: distinct payment invoice_ids with no invoice row."""
    bad = payments.select("invoice_id").distinct().join(invoices.select("invoice_id"), "invoice_id", "left_anti")
    return _v(bad, "payments", "fk_invoice", "error", "invoice_id", F.lit("Payments reference non-existent invoices"))


def _valid_invoice(invoices: DataFrame) -> Column:
    return F.aggregate(
        F.array(*[F.coalesce(ok, F.lit(False)) for _, ok in invoice_checks(invoices)]), F.lit(True), lambda a, b: a & b
    )


def due_before_issue(invoices: DataFrame) -> DataFrame:
    """DQ-9: due_date before issue_date (error), for rows that pass the DQ-4 rules."""
    bad = invoices.where(_valid_invoice(invoices) & (F.col("due_date") < F.col("issue_date")))
    return _v(bad, "invoices", "due_before_issue", "error", "invoice_id",
              F.concat(F.lit("Invoice "), F.col("invoice_id"), F.lit(": due_date before issue_date")))


def created_before_issue(invoices: DataFrame) -> DataFrame:
    """DQ-10: created_at before issue_date (warning), for rows that pass the DQ-4 rules."""
    bad = invoices.where(_valid_invoice(invoices) & (F.col("created_at") < F.col("issue_date")))
    return _v(bad, "invoices", "created_before_issue", "warning", "invoice_id",
              F.concat(F.lit("Invoice "), F.col("invoice_id"), F.lit(": created_at before issue_date")))


def invoice_violations(invoices: DataFrame) -> DataFrame:
    """DQ-4 + DQ-9 + DQ-10 in one pass over the invoices: row rules, then the date-order rules for valid rows."""
    checks = invoice_checks(invoices)
    oks = [F.coalesce(ok, F.lit(False)) for _, ok in checks]
    valid = F.aggregate(F.array(*oks), F.lit(True), lambda a, b: a & b)
    iid = F.col("invoice_id")
    items = [
        F.when(~ok, F.struct(F.lit(f"invoices_row:{name}").alias("rule"), F.lit("error").alias("severity"),
                             F.lit(f"invalid {name}").alias("message")))
        for (name, _), ok in zip(checks, oks)
    ] + [
        F.when(valid & (F.col("due_date") < F.col("issue_date")), F.struct(
            F.lit("due_before_issue").alias("rule"), F.lit("error").alias("severity"),
            F.concat(F.lit("Invoice "), iid, F.lit(": due_date before issue_date")).alias("message"))),
        F.when(valid & (F.col("created_at") < F.col("issue_date")), F.struct(
            F.lit("created_before_issue").alias("rule"), F.lit("warning").alias("severity"),
            F.concat(F.lit("Invoice "), iid, F.lit(": created_at before issue_date")).alias("message"))),
    ]
    x = invoices.select(iid.alias("__k"), F.explode(F.filter(F.array(*items), lambda v: v.isNotNull())).alias("v"))
    return x.select(
        F.lit("invoices").alias("table"), F.col("v.rule").alias("rule"), F.col("v.severity").alias("severity"),
        F.col("__k").cast("string").alias("key"), F.col("v.message").alias("message"),
    )


def missing_contacts(customers: DataFrame) -> DataFrame:
    """DQ-11: count of customers missing email / phone (warnings; phone skipped when the column is absent, D23)."""
    aggs = [F.count_if(F.col("email").isNull()).alias("email")]
    if "phone" in customers.columns:
        aggs.append(F.count_if(F.col("phone").isNull()).alias("phone"))
    c = customers.agg(*aggs)
    parts = [
        _v(c.where(F.col(f) > 0), "customers", f"missing_{f}", "warning", F.lit(None),
           F.concat(F.col(f).cast("string"), F.lit(f" customers missing {f}")))
        for f in [a for a in ("email", "phone") if a in c.columns]
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overpayments(payments: DataFrame, invoices: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """DQ-12: invoices whose payments (any status) exceed the amount by more than ``tolerance``."""
    paid = payments.groupBy("invoice_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("paid"))
    # Duplicate invoice ids take the first amount in the reference (set_index lookup); here: the smallest id row.
    inv = invoices.groupBy("invoice_id").agg(F.min("invoice_amount").alias("invoice_amount"))
    bad = paid.join(inv, "invoice_id").where(F.col("paid") > F.col("invoice_amount") * (1 + tolerance))
    return _v(bad, "payments", "overpayment", "warning", "invoice_id",
              F.format_string("Invoice %s: payments ($%.2f) exceed invoice amount ($%.2f)", F.col("invoice_id"),
                              F.col("paid"), F.col("invoice_amount")))


def validate_all(customers: DataFrame, invoices: DataFrame, payments: DataFrame | None = None) -> DataFrame:
    """DQ-13 input: every violation of every rule over the three tables.

    DQ-1 first: a table missing required columns gets one error row and none of its other rules (as the reference
    stops validating that table); rules that join two tables run only when both have their columns.
    """
    spark = customers.sparkSession
    tables = {"customers": customers, "invoices": invoices}
    if payments is not None:
        tables["payments"] = payments
    missing = {name: missing_columns(df, name) for name, df in tables.items()}
    ok = {name: not cols for name, cols in missing.items()}
    parts = [
        spark.createDataFrame([(name, "missing_columns", "error", None, f"Missing required columns: {cols}")], VIOLATION_SCHEMA)
        for name, cols in missing.items() if cols
    ]
    if ok["customers"]:
        parts += [_dup_keys(customers, "customers", "customer_id"), customer_rows(customers), missing_contacts(customers)]
    if ok["invoices"]:
        parts += [_dup_keys(invoices, "invoices", "invoice_id"), invoice_violations(invoices)]
        if ok["customers"]:
            parts.append(fk_invoices(invoices, customers))
    if payments is not None and ok["payments"]:
        parts += [_dup_keys(payments, "payments", "payment_id"), payment_rows(payments)]
        if ok["invoices"]:
            parts += [fk_payments(payments, invoices), overpayments(payments, invoices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(violations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-13: per table row count, errors, warnings and verdict (valid when no error row)."""
    counts = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        counts = c if counts is None else counts.unionByName(c)
    v = violations.groupBy("table").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return counts.join(v, "table", "left").select(
        "table", "row_count",
        F.coalesce(F.col("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.col("warnings"), F.lit(0)).alias("warnings"),
        (F.coalesce(F.col("errors"), F.lit(0)) == 0).alias("is_valid"),
    )


def parse_dates(raw: DataFrame, column: str = "raw_date", key: str = "row_id") -> DataFrame:
    """DQ-14: normalise multi-format date strings; rejects keep a NULL ``parsed`` and ``is_valid = false``."""
    p = dates.parse_date(F.col(column))
    return raw.select(key, column, p.alias("parsed"), p.isNotNull().alias("is_valid"))
