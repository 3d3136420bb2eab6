"""Edge cases of the metrics."""

import datetime as dt

from receivables.operators import aging, forecast, metrics, scoring

AS_OF = dt.date(2001, 6, 30)
INV = "invoice_id string, customer_id string, issue_date date, due_date date, invoice_amount double, currency string, status string"
CUST = "customer_id string, name string, payment_terms_days int, credit_limit double"
PAY = "payment_id string, invoice_id string, payment_date date, amount double, status string"


def test_no_open_ar(spark):
    inv = spark.createDataFrame([("I1", "C1", dt.date(2001, 1, 1), dt.date(2001, 2, 1), 100.0, "USD", "paid")], INV)
    cust = spark.createDataFrame([("C1", "A", 30, 1000.0), ("C2", "B", 30, 1000.0)], CUST)
    assert aging.aging_summary(inv, AS_OF).count() == 0
    r = metrics.customer_risk(inv, cust, None).collect()
    assert [(x.customer_id, x.ar_concentration) for x in r] == [("C1", 0.0)]  # C2 has no invoices (D7); 0 AR (D6)
    s = metrics.ar_summary(inv, None, AS_OF).first()
    assert (s.total_ar, s.overdue_percentage, s.avg_invoice_amount) == (0.0, 0.0, 0.0)
    g = forecast.cash_gap(inv, AS_OF).first()
    assert (g.total_ar, g.gap_percentage) == (0.0, 0.0)


def test_no_sales_in_period_and_cei_denominator(spark):
    inv = spark.createDataFrame([("I1", "C1", dt.date(2000, 1, 1), dt.date(2000, 2, 1), 100.0, "USD", "paid")], INV)
    assert metrics.dso(inv, AS_OF).first().dso == 0.0
    assert metrics.cei(inv, AS_OF).first().cei == 100.0


def test_rule_score_zero_limit_and_unknown_customer(spark):
    inv = spark.createDataFrame([
        ("I1", "C1", dt.date(2001, 6, 1), dt.date(2001, 7, 1), 100.0, "USD", "open"),
        ("I2", "C9", dt.date(2001, 1, 1), dt.date(2001, 1, 31), 100.0, "USD", "open"),
        ("I3", "C3", dt.date(2001, 6, 1), dt.date(2001, 7, 1), 0.0, "USD", "open"),
    ], INV)
    cust = spark.createDataFrame([("C1", "A", 60, 0.0), ("C3", "C", 0, 0.0)], CUST)
    got = {r.invoice_id: r.risk_score for r in scoring.rule_risk_scores(inv, cust, AS_OF).collect()}
    # I1: not overdue, amount = p95 -> 20, terms 60 -> 20, zero limit with AR -> 20 => 60
    # I2: 150 days overdue -> 40, amount 20, default terms 30 -> 10, limit 999999 -> ~0 => 70
    # I3: zero amount and zero limit (0/0) -> utilisation 0
    assert got == {"I1": 60, "I2": 70, "I3": 0}


def test_payment_behavior_without_late(spark):
    inv = spark.createDataFrame([("I1", "C1", dt.date(2001, 1, 1), dt.date(2001, 2, 1), 100.0, "USD", "paid")], INV)
    pay = spark.createDataFrame([("P1", "I1", dt.date(2001, 1, 20), 100.0, "completed")], PAY)
    b = metrics.payment_behavior(inv, pay).first()
    assert (b.paid_invoices, b.late_payment_count, b.avg_days_late, b.max_days_late, b.avg_days_to_payment) == (1, 0, 0.0, 0, 19.0)


def test_partial_payments_pass_100_percent(spark):
    inv = spark.createDataFrame([("I1", "C1", dt.date(2001, 1, 1), dt.date(2001, 2, 1), 100.0, "USD", "open")], INV)
    pay = spark.createDataFrame([("P1", "I1", dt.date(2001, 2, 5), 50.0, "completed"),
                                 ("P2", "I1", dt.date(2001, 2, 9), 50.0, "failed")], PAY)
    b = metrics.payment_behavior(inv, pay).first()
    assert b.payment_rate == 200.0  # D1: every pair counts, failed payments included
    assert metrics.payment_behavior(inv, pay, completed_only=True).first().payment_rate == 100.0


def test_month_end_as_of_is_included(spark):
    ends = [r.month_end for r in aging.month_ends(spark, dt.date(2001, 6, 30), 3).collect()]
    assert sorted(ends) == [dt.date(2001, 4, 30), dt.date(2001, 5, 31), dt.date(2001, 6, 30)]
    ends = [r.month_end for r in aging.month_ends(spark, dt.date(2001, 6, 29), 2).collect()]
    assert sorted(ends) == [dt.date(2001, 4, 30), dt.date(2001, 5, 31)]


def test_default_payment_pattern(spark):
    inv = spark.createDataFrame([("I1", "C1", dt.date(2001, 6, 1), dt.date(2001, 7, 1), 100.0, "USD", "open")], INV)
    pay = spark.createDataFrame([], PAY)
    p = forecast.payment_pattern(inv, pay).first()
    assert (p.avg_days_after_due, p.std_days_after_due, p.payment_probability) == (7.0, 14.0, 0.8)
    f = forecast.forecast_inflows(inv, None, AS_OF).first()
    assert (f.forecast_7d, f.forecast_14d, f.forecast_30d) == (0.0, 80.0, 80.0)
