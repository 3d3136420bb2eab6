"""Data quality: the reference's three validator tests plus one failing row per rule (DQ-*)."""

import datetime as dt

from receivables.operators import quality

CUST_SCHEMA = ("customer_id string, name string, email string, phone string, industry string, country string, "
               "state string, payment_terms_days int, credit_limit double, created_at date")
VALID = ("CUST-001", "Test Co", "test@test.com", "555-1234", "Tech", "US", "CA", 30, 10000.0, dt.date(2024, 1, 1))


def rules(df):
    return sorted((r.rule, r.key) for r in df.collect())


def test_valid_customer(spark):
    c = spark.createDataFrame([VALID], CUST_SCHEMA)
    assert quality.customer_rows(c).count() == 0
    assert quality.duplicate_keys(c, c.limit(0).selectExpr("'x' AS invoice_id"), c.limit(0).selectExpr("'x' AS payment_id")).count() == 0


def test_missing_columns(spark):
    c = spark.createDataFrame([("CUST-001", "Test Co")], "customer_id string, name string")
    assert quality.missing_columns(c, "customers") == ["country", "created_at", "credit_limit", "email", "payment_terms_days"]


def test_duplicate_customer_ids(spark):
    c = spark.createDataFrame([VALID, VALID], CUST_SCHEMA)
    out = quality._dup_keys(c, "customers", "customer_id").collect()
    assert [(r.rule, r.key, r.severity) for r in out] == [("duplicate_key", "CUST-001", "error")]


def test_customer_row_rules(spark):
    bad = [
        ("C1", "", "a@b.com", None, None, "US", None, 30, 1.0, dt.date(2024, 1, 1)),
        ("C2", "n", "not-an-email", None, None, "US", None, 30, 1.0, dt.date(2024, 1, 1)),
        ("C3", "n", "a@b.com", None, None, "USA", None, 30, 1.0, dt.date(2024, 1, 1)),
        ("C4", "n", "a@b.com", None, None, "US", None, 400, 1.0, dt.date(2024, 1, 1)),
        ("C5", "n", "a@b.com", None, None, "US", None, 30, -1.0, dt.date(2024, 1, 1)),
        ("C6", "n", "a@b.com", None, None, "US", None, 30, 1.0, None),
        ("C7", " n ", " a@b.com ", None, None, " US ", None, 0, 0.0, dt.date(2024, 1, 1)),
    ]
    c = spark.createDataFrame(bad, CUST_SCHEMA)
    assert rules(quality.customer_rows(c)) == [
        ("customers_row:country", "C3"), ("customers_row:created_at", "C6"), ("customers_row:credit_limit", "C5"),
        ("customers_row:email", "C2"), ("customers_row:name", "C1"), ("customers_row:payment_terms_days", "C4"),
    ]
    warn = {r.rule: r.message for r in quality.missing_contacts(c).collect()}
    assert warn == {"missing_phone": "7 customers missing phone"}


INV_SCHEMA = ("invoice_id string, customer_id string, issue_date date, due_date date, invoice_amount double, "
              "currency string, status string, invoice_type string, channel string, created_at date")


def inv(i, **kw):
    row = dict(invoice_id=i, customer_id="CUST-001", issue_date=dt.date(2024, 1, 10), due_date=dt.date(2024, 2, 10),
               invoice_amount=100.0, currency="USD", status="open", invoice_type="one_time", channel="online",
               created_at=dt.date(2024, 1, 10))
    row.update(kw)
    return tuple(row[k] for k in ["invoice_id", "customer_id", "issue_date", "due_date", "invoice_amount", "currency",
                                  "status", "invoice_type", "channel", "created_at"])


def test_invoice_rules(spark):
    rows = [
        inv("I1", invoice_amount=0.0), inv("I2", currency="US"), inv("I3", status="unknown"), inv("I4", status=" OPEN "),
        inv("I5", invoice_type="x"), inv("I6", channel="x"), inv("I7", due_date=dt.date(2024, 1, 1)),
        inv("I8", created_at=dt.date(2024, 1, 9)), inv("I9", customer_id="CUST-404"),
        inv("I10", invoice_amount=-1.0, due_date=dt.date(2024, 1, 1)),
    ]
    i = spark.createDataFrame(rows, INV_SCHEMA)
    c = spark.createDataFrame([VALID], CUST_SCHEMA)
    assert rules(quality.invoice_rows(i)) == [
        ("invoices_row:channel", "I6"), ("invoices_row:currency", "I2"), ("invoices_row:invoice_amount", "I1"),
        ("invoices_row:invoice_amount", "I10"), ("invoices_row:invoice_type", "I5"), ("invoices_row:status", "I3"),
    ]
    # Only rows that pass the row rules get the date-order checks (I10 fails the amount rule first).
    assert rules(quality.due_before_issue(i)) == [("due_before_issue", "I7")]
    assert [r.severity for r in quality.created_before_issue(i).collect()] == ["warning"]
    assert rules(quality.fk_invoices(i, c)) == [("fk_customer", "CUST-404")]


def test_payment_rules_and_overpayment(spark):
    pay_schema = "payment_id string, invoice_id string, payment_date date, amount double, method string, status string"
    p = spark.createDataFrame([
        ("P1", "I1", dt.date(2024, 2, 1), 60.0, "ach", "completed"),
        ("P2", "I1", dt.date(2024, 2, 2), 41.5, "bitcoin", "failed"),
        ("P3", "I9", dt.date(2024, 2, 2), 0.0, "wire", "done"),
    ], pay_schema)
    i = spark.createDataFrame([inv("I1")], INV_SCHEMA)
    assert rules(quality.payment_rows(p)) == [("payments_row:amount", "P3"), ("payments_row:method", "P2"),
                                              ("payments_row:status", "P3")]
    assert rules(quality.fk_payments(p, i)) == [("fk_invoice", "I9")]
    over = quality.overpayments(p, i).collect()
    assert [(r.key, r.message) for r in over] == [("I1", "Invoice I1: payments ($101.50) exceed invoice amount ($100.00)")]


def test_summary_verdict(spark):
    c = spark.createDataFrame([VALID], CUST_SCHEMA)
    i = spark.createDataFrame([inv("I1"), inv("I2", currency="US")], INV_SCHEMA)
    s = {r.table: (r.row_count, r.errors, r.is_valid) for r in quality.summary(quality.validate_all(c, i), {"customers": c, "invoices": i}).collect()}
    assert s == {"customers": (1, 0, True), "invoices": (2, 1, False)}


def test_action_rules(spark):
    a = spark.createDataFrame([("A1", "I1", "reminder1", "2024-01-01", None, "pending"),
                               ("A2", "I1", "shout", "2024-13-01", "x" * 1001, "maybe")],
                              "action_id string, invoice_id string, action_type string, action_date string, notes string, outcome string")
    assert rules(quality.action_rows(a)) == [("actions_row:action_date", "A2"), ("actions_row:action_type", "A2"),
                                             ("actions_row:notes", "A2"), ("actions_row:outcome", "A2")]


def test_validate_all_stops_table_with_missing_columns(spark):
    c = spark.createDataFrame([("CUST-001", "Test Co")], "customer_id string, name string")
    i = spark.createDataFrame([inv("I1", customer_id="CUST-404")], INV_SCHEMA)
    v = quality.validate_all(c, i).collect()
    rules = sorted((r.table, r.rule) for r in v)
    # customers: only the DQ-1 error; invoices: their own rules run, the FK check needs customer columns and is skipped
    assert rules == [("customers", "missing_columns")]
    assert "payment_terms_days" in v[0].message
