"""Sources and sinks (SRC-*, SNK-*), audit appends (AU-1, AU-2, OU-7) and model persistence (ML-8)."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from receivables.operators import audit, outreach, quality
from receivables.plans import commands
from receivables.sources import tables


def write_csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


@pytest.fixture()
def data_dir(scratch):
    d = os.path.join(scratch, "data")
    os.makedirs(d)
    write_csv(f"{d}/customers.csv", ["customer_id", "name", "email", "phone", "industry", "country", "state",
                                     "payment_terms_days", "credit_limit", "created_at"],
              [("CUST-001", "Test Co", "test@test.com", "555-1234", "Tech", "US", "CA", 30, 10000, "2024-01-01")])
    write_csv(f"{d}/invoices.csv", ["invoice_id", "customer_id", "issue_date", "due_date", "invoice_amount", "currency",
                                    "status", "invoice_type", "channel", "created_at"],
              [("INV-1", "CUST-001", "2024-01-01", "31/01/2024", 500.0, "USD", "open", "one_time", "online", "2024-01-01"),
               ("INV-2", "CUST-001", "2024/02/01", "2024-03-02", 700.0, "USD", "paid", "recurring", "offline", "2024-02-01")])
    return d


def test_loader_reads_and_parses_dates(spark, data_dir):
    loader = tables.DataLoader(spark, data_dir)
    c, i, p, a = loader.load_all(validate=True)
    assert p is None and a.count() == 0 and a.columns == ["action_id", "invoice_id", "action_type", "action_date", "notes", "outcome"]
    due = {r.invoice_id: r.due_date for r in i.collect()}
    assert due == {"INV-1": dt.date(2024, 1, 31), "INV-2": dt.date(2024, 3, 2)}
    assert dict(c.dtypes)["created_at"] == "date"


def test_loader_missing_required(spark, scratch):
    with pytest.raises(FileNotFoundError):
        tables.DataLoader(spark, scratch).load_customers()


def test_loader_validation_fails(spark, data_dir):
    with open(f"{data_dir}/invoices.csv", "a") as f:
        f.write("INV-3,CUST-404,2024-01-01,2024-01-31,-5,USD,open,one_time,online,2024-01-01\n")
    with pytest.raises(ValueError):
        tables.DataLoader(spark, data_dir).load_all(validate=True)


def test_save_append_and_report(spark, data_dir, scratch):
    c, i, p, _ = tables.DataLoader(spark, data_dir).load_all()
    out = os.path.join(scratch, "out")
    tables.save(i, f"{out}/inv_csv", fmt="csv")
    back = tables.read_table(spark, f"{out}/inv_csv", "invoices", fmt="csv")
    assert back.count() == 2
    tables.append(i, f"{out}/inv_pq")
    tables.append(i, f"{out}/inv_pq")
    assert spark.read.parquet(f"{out}/inv_pq").count() == 4
    rep = commands.analyze(i, p, dt.date(2024, 2, 15))
    tables.save(rep.coalesce(1), f"{out}/report", fmt="json")
    files = [f for f in os.listdir(f"{out}/report") if f.endswith(".json")]
    doc = json.loads(open(f"{out}/report/{files[0]}").read())
    assert doc["as_of"] == "2024-02-15" and doc["ar_summary"]["total_ar"] == 500.0
    assert [b["aging_bucket"] for b in doc["aging_summary"]] == ["1-15"]  # 15 days past 2024-01-31


def test_schedule_roundtrip(spark, scratch):
    s = spark.createDataFrame([("I1", "C1", 1, dt.date(2001, 7, 2), "friendly_reminder", 1, 41, "pending")],
                              "invoice_id string, customer_id string, attempt_number int, scheduled_date date, "
                              "action_type string, days_from_last_contact int, estimated_days_overdue int, status string")
    for c in ["reschedule_reason", "completed_date", "completion_notes", "cancellation_reason", "cancelled_date"]:
        s = s.withColumn(c, F.lit(None).cast("string"))
    tables.save(s, f"{scratch}/sched", fmt="csv")
    back = tables.read_schedule(spark, f"{scratch}/sched")
    assert back.first().scheduled_date == dt.date(2001, 7, 2)


def test_csv_is_read_by_header(spark, data_dir):
    """Other order, an extra column, optional columns missing, a number that does not parse."""
    write_csv(f"{data_dir}/customers.csv", ["name", "customer_id", "email", "country", "note", "payment_terms_days", "credit_limit", "created_at"],
              [("Acme", "CUST-1", "a@b.com", "US", "vip", 30, "lots", "2024-01-01"), ("Bolt", "CUST-2", "c@d.com", "DE", "", "x", 5.5, "2024-01-02")])
    df = tables.DataLoader(spark, data_dir).load_customers()
    assert df.columns == ["customer_id", "name", "email", "phone", "industry", "country", "state", "payment_terms_days", "credit_limit", "created_at", "note"]
    one, two = df.orderBy("customer_id").collect()
    assert (one.customer_id, one.name, one.country, one.payment_terms_days, one.credit_limit, one.phone, one.note) == ("CUST-1", "Acme", "US", 30, None, None, "vip")
    assert (two.payment_terms_days, two.credit_limit, two.created_at) == (None, 5.5, dt.date(2024, 1, 2))


def test_missing_required_column_is_reported(spark, data_dir):
    """DQ-1 over a CSV: the column is absent from the frame, and load_all says so."""
    write_csv(f"{data_dir}/invoices.csv", ["invoice_id", "customer_id", "issue_date", "invoice_amount", "currency", "status", "invoice_type", "channel", "created_at"],
              [("INV-1", "CUST-001", "2024-01-01", 500.0, "USD", "open", "one_time", "online", "2024-01-01")])
    loader = tables.DataLoader(spark, data_dir)
    assert quality.missing_columns(loader.load_invoices(), "invoices") == ["due_date"]
    with pytest.raises(ValueError, match="missing_columns"):
        loader.load_all(validate=True)


def test_folder_of_csv_files_must_agree(spark, scratch):
    d = f"{scratch}/payments.csv"
    os.makedirs(d)
    header = ["payment_id", "invoice_id", "payment_date", "amount", "method", "status"]
    write_csv(f"{d}/a.csv", header, [("P1", "I1", "2024-01-01", 5, "ach", "completed")])
    assert tables.read_table(spark, d, "payments", fmt="csv").first().amount == 5.0
    write_csv(f"{d}/b.csv", [*header[:2], "amount", "payment_date", "method", "status"], [("P2", "I1", 5, "2024-01-01", "ach", "completed")])
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_table(spark, d, "payments", fmt="csv").collect()


def test_transactions_by_header(spark, scratch):
    write_csv(f"{scratch}/tx.csv", ["Country", "InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"],
              [("France", "536365", "A1", 6, "2010-12-01", 2.55, 17850.0), ("Spain", "536366", "B2", 1, "2010-12-02", 1.0, "")])
    rows = {r.invoice_no: r for r in tables.read_transactions(spark, f"{scratch}/tx.csv").collect()}
    assert rows["536365"].unit_price == 2.55 and rows["536365"].customer_key == 17850.0 and rows["536365"].country == "France"
    assert rows["536366"].customer_key is None and rows["536365"].line_no != rows["536366"].line_no
    write_csv(f"{scratch}/bad.csv", ["InvoiceNo", "Quantity"], [("1", 2)])
    with pytest.raises(ValueError, match="unit_price"):
        tables.read_transactions(spark, f"{scratch}/bad.csv")


def test_csv_actions_have_whole_ids(spark):
    ids = spark.createDataFrame([("INV-1",), ("INV-2",)], "invoice_id string")
    new = audit.new_csv_actions(ids, "reminder1", dt.datetime(2024, 2, 1, 9, 0), "sent")
    rows = new.collect()
    assert all(r.action_id.startswith("ACT-") and len(r.action_id) == 36 and r.short_id == r.action_id[:12] and r.outcome == "pending" for r in rows)
    existing = spark.createDataFrame([], tables.ACTIONS_SCHEMA)
    assert audit.append_actions(existing, new).count() == 2


def test_audit_append_gives_ids_and_checks_the_table(spark, scratch):
    path = f"{scratch}/audit"
    msgs = spark.createDataFrame([("I1", "C1", "friendly_reminder", "body", "high"), ("I2", "C1", "escalate", "b", None)],
                                 "invoice_id string, customer_id string, action_type string, email_body string, risk_category string")
    first = audit.append_batch(outreach.log_messages(msgs, dt.datetime(2024, 2, 1)), path)
    given = outreach.log_messages(msgs, dt.datetime(2024, 3, 1)).withColumn("action_id", F.when(F.col("invoice_id") == "I1", F.lit("mine")))
    second = audit.append_batch(given, path)
    ids = {r.action_id for r in first.collect()} | {r.action_id for r in second.collect()}
    assert len(ids) == 4 and "mine" in ids and None not in ids
    back = spark.read.parquet(path)
    assert {r.action_id for r in back.collect()} == ids and back.where("action_month = '2024-03'").count() == 2
    assert {r.notes for r in back.collect()} == {"Generated by CLI - Risk: high", "Generated by CLI - Risk: unknown"}
    with pytest.raises(ValueError, match="invoice_id"):
        audit.append_batch(given.withColumn("invoice_id", F.lit(5)), path)
    with pytest.raises(ValueError, match="extra"):
        audit.append_batch(given.withColumn("extra", F.lit(5)), path)
    assert spark.read.parquet(path).count() == 4
    responses = spark.createDataFrame([("mine", dt.datetime(2024, 3, 2), "email")], "action_id string, response_date timestamp_ntz, response_type string")
    out = audit.append_batch(responses, f"{scratch}/responses", id_col="response_id", partition_by=None)
    assert out.first().response_id == spark.read.parquet(f"{scratch}/responses").first().response_id


def test_outcomes_without_an_action_stay_in_the_history(spark):
    actions = spark.createDataFrame([("1", "I1", "C1", "call", dt.datetime(2024, 1, 5), "phone", "me", None), ("2", "I2", "C2", "call", dt.datetime(2024, 1, 6), "phone", "me", None)],
                                    "action_id string, invoice_id string, customer_id string, action_type string, action_date timestamp_ntz, channel string, sent_by string, notes string")
    responses = spark.createDataFrame([("9", "1", dt.datetime(2024, 1, 7), "email", True)], "response_id string, action_id string, response_date timestamp_ntz, response_type string, payment_promised boolean")
    outcomes = spark.createDataFrame([("5", "I1", None, "paid", dt.datetime(2024, 1, 8), 50.0, 3), ("6", "I1", "gone", "partial", dt.datetime(2024, 1, 9), 7.0, 4), ("7", "I1", "1", "paid", dt.datetime(2024, 1, 9), 1.0, 4)],
                                     "outcome_id string, invoice_id string, action_id string, outcome_type string, outcome_date timestamp_ntz, amount_collected double, days_to_payment int")
    h = audit.invoice_history(actions, responses, outcomes, "I1").collect()
    assert [(r.action_id, r.amount_collected, r.invoice_outcomes, r.invoice_amount_collected) for r in h][0] == ("1", 1.0, 3, 58.0)
    assert sorted(r.amount_collected for r in h if r.action_id is None) == [7.0, 50.0]
    c = audit.customer_history(actions, responses, outcomes, "C1").collect()
    assert len(c) == 3 and {r.customer_id for r in c} == {"C1"}
    e = audit.audit_export(actions, responses, outcomes, start=dt.datetime(2024, 1, 6), end=dt.datetime(2024, 1, 8, 12)).collect()
    assert sorted((r.action_id or "", r.amount_collected or 0) for r in e) == [("", 50.0), ("2", 0)]


def test_log_messages(spark):
    msgs = spark.createDataFrame([("I1", "C1", "friendly_reminder", "body", "high")],
                                 "invoice_id string, customer_id string, action_type string, email_body string, risk_category string")
    r = outreach.log_messages(msgs, dt.datetime(2024, 1, 1)).first()
    assert r.channel == "email" and r.notes == "Generated by CLI - Risk: high" and r.message_sent == "body"
