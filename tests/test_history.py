"""Point-in-time history, the aging sweep, raw CSV cells and appends that happen once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from receivables.operators import aging, audit, features, history, quality
from receivables.sources import tables

DAY = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def made(spark):
    """Random invoices (one customer has a third), payments before and after issue, null dates and customers."""
    rng = random.Random(6)
    invoices = []
    for i in range(240):
        issue = rng.choice([None, *range(60)]) if rng.random() < 0.1 else rng.randrange(60)
        due = None if rng.random() < 0.05 else (issue or 0) + rng.randrange(-3, 40)
        customer = rng.choice(["hot", None, "a", "b", "c"]) if i % 3 else "hot"
        invoices.append((f"I{i}", customer, issue, due, round(rng.random() * 1000, 2), rng.choice(["open", "paid"])))
    payments = [(f"P{k}", f"I{rng.randrange(240)}", rng.choice([None, *range(-5, 90)]), round(rng.random() * 500, 2)) for k in range(200)]
    inv = spark.createDataFrame([(i, c, day(s), day(d), a, t) for i, c, s, d, a, t in invoices], "invoice_id string, customer_id string, issue_date date, due_date date, invoice_amount double, status string")
    pay = spark.createDataFrame([(p, i, day(d), a) for p, i, d, a in payments], "payment_id string, invoice_id string, payment_date date, amount double")
    return invoices, payments, inv, pay


def test_history_at_issue_sees_the_past_only(spark, made):
    invoices, payments, inv, pay = made
    known = []
    for i, c, s, d, _, _ in invoices:
        mine = [p for p in payments if p[1] == i] or [(None, i, None, None)]
        for _, _, paid, amount in mine:
            late = 0 if paid is None else None if d is None else max(0, paid - d)
            if s is not None and c is not None:
                known.append((c, max(s, s if paid is None else paid), late, amount))
    got = {r.invoice_id: r for r in history.history_at_issue(inv, pay).collect()}
    assert len(got) == len(invoices)
    for i, c, s, _, _, _ in invoices:
        before = [k for k in known if c is not None and s is not None and k[0] == c and k[1] < s]
        lates, paid = [k[2] for k in before if k[2] is not None], [k[3] for k in before if k[3] is not None]
        r = got[i]
        assert r.customer_invoice_count == len(before)
        assert r.customer_avg_days_late == pytest.approx(sum(lates) / len(lates) if lates else 0.0)
        assert r.customer_late_rate == pytest.approx(100 * sum(x > 0 for x in lates) / len(before) if before else 0.0, abs=0.005)
        assert (r.customer_avg_payment_amount is None) == (not paid) and (not paid or r.customer_avg_payment_amount == pytest.approx(sum(paid) / len(paid)))


def test_history_by_day_is_the_history_of_that_day(spark, made):
    _, _, inv, pay = made
    asked = inv.select("customer_id").distinct().withColumn("day", F.lit(day(41)))
    want = {tuple(r) for r in features.customer_history(inv, pay, day(41)).collect()}
    assert {tuple(r) for r in history.history_by_day(inv, pay, asked).drop("day").collect()} == want and len(want) == 4


def test_running_sums_have_a_row_per_day(spark, made):
    """What the window sorts is bounded by the calendar, not by a customer's invoices."""
    _, _, inv, pay = made
    many = inv.crossJoin(spark.range(50)).withColumn("invoice_id", F.concat("invoice_id", F.lit("-"), "id")).drop("id")
    per = history.daily_changes(many, pay).groupBy("customer_id").count().collect()
    assert max(r["count"] for r in per) <= 100 < many.where("customer_id = 'hot'").count()
    plan = history.history_at_issue(inv, pay)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("paid", [True, False])
def test_aging_on_any_days(spark, made, paid):
    invoices, payments, inv, pay = made
    first = {}
    for _, i, d, _ in payments:
        if d is not None:
            first[i] = min(first.get(i, d), d)
    days = [-3, 0, 7, 30, 59, 60, 95, 150, 400]
    asked = spark.createDataFrame([(day(d),) for d in days], "day date")
    got = {r.day: r for r in aging.aging_at(inv, pay if paid else None, asked).collect()}
    for d in days:
        want = dict.fromkeys(["current", "1-15", "16-30", "31-60", "61-90", "90+"], 0.0)
        for i, _, s, due, amount, status in invoices:
            if s is None or s > d or (first.get(i, d + 1) <= d if paid else status != "open"):
                continue
            over = 0 if due is None else max(0, d - due)
            want[next(b for b, top in zip(want, (0, 15, 30, 60, 90, 10**9), strict=True) if over <= top)] += amount
        r = got[day(d)]
        assert [r[b] for b in want] == pytest.approx(list(want.values())) and r.total_ar == pytest.approx(sum(want.values()))


def test_aging_does_not_cross_invoices_with_dates(spark, made):
    _, _, inv, pay = made
    plan = aging.aging_trend(inv, pay, day(90), 24)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and aging.bucket_events(inv, pay).count() <= 6 * 110
    assert aging.aging_daily(inv, pay, day(90)).count() == 91 and aging.aging_daily(inv.limit(0), pay, day(90)).count() == 0


CSV = """customer_id,extra,invoice_id,issue_date,due_date,invoice_amount,currency,status,invoice_type,channel,created_at
C1,x,I1,2024-01-05,2024-02-05, 10.5 ,USD,open,one_time,online,2024-01-05
C1,x,I2,2024-13-05,05/02/2024,ten,USD,open,one_time,online,2024-01-05
C1,x,I3,2024-01-05,,,USD,open,one_time,online,2024-01-05
C1,x,I4,2024-01-05
C1,x,I5,2024-01-05,2024-02-05,NaN,USD,open,one_time,online,later
"""


def test_bad_cells_keep_their_text(spark, scratch):
    with open(f"{scratch}/invoices.csv", "w") as f:
        f.write(CSV)
    with open(f"{scratch}/customers.csv", "w") as f:
        f.write("customer_id,name,email,country,payment_terms_days,credit_limit,created_at\nC1,N,a@b.co,US,30.0,1e3,2024-01-01\nC2,N,a@b.co,US,30.5,1_000,2024-01-01\n")
    cells = tables.read_cells(spark, f"{scratch}/invoices.csv")
    got = {(r.key, r.rule, r.raw) for r in quality.bad_cells(cells, "invoices").collect()}
    assert got == {("I2", "unreadable:issue_date", "2024-13-05"), ("I2", "unreadable:invoice_amount", "ten"), ("I4", "malformed_line", "C1,x,I4,2024-01-05"),
                   ("I5", "unreadable:invoice_amount", "NaN"), ("I5", "unreadable:created_at", "later")}
    typed = {r.invoice_id: r for r in tables.typed_cells(cells, "invoices").collect()}
    assert typed["I1"].invoice_amount == 10.5 and typed["I2"].due_date == dt.date(2024, 2, 5) and typed["I2"].invoice_amount is None and typed["I1"].extra == "x"
    loader = tables.DataLoader(spark, scratch)
    found = {(r.table, r.key, r.raw, r.file) for r in loader.bad_cells().collect()}
    assert ("customers", "C2", "30.5", "customers.csv") in found and ("customers", "C2", "1_000", "customers.csv") in found and len(found) == 7
    with pytest.raises(ValueError, match="cannot read"):
        loader.load_all(validate=True)


ACTIONS = "invoice_id string, customer_id string, action_type string, action_date timestamp_ntz, notes string"


def actions(spark, rows):
    return spark.createDataFrame([(i, "C", "call", dt.datetime(2024, m, 3), n) for i, m, n in rows], ACTIONS)


def test_a_repeated_batch_replaces_itself(spark, scratch, monkeypatch):
    path = f"{scratch}/audit"
    one = actions(spark, [("I1", 1, "x"), ("I1", 1, "x"), ("I2", 2, None)])
    first = {r.action_id for r in audit.append_batch(one, path, batch_id="b1").collect()}
    audit.append_batch(actions(spark, [("I9", 1, "other")]), path, batch_id="b2")
    again = audit.append_batch(one.repartition(5), path, batch_id="b1")
    assert {r.action_id for r in again.collect()} == first and len(first) == 3 and again.columns[-1] == "created_at"
    rows = spark.read.parquet(path)
    assert rows.count() == 4 and rows.where("action_month = '2024-01'").count() == 3
    # Fails between the write and the return: the next try replaces what was written.
    with monkeypatch.context() as m:
        m.setattr(type(spark.read), "parquet", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        m.setattr(audit, "_table_schema", lambda *a: None)
        with pytest.raises(OSError, match="lost"):
            audit.append_batch(actions(spark, [("I7", 3, "late")]), path, batch_id="b3")
    assert spark.read.parquet(path).count() == 5
    assert audit.append_batch(actions(spark, [("I7", 3, "late")]), path, batch_id="b3").count() == 1
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="kept with batch ids"):
        audit.append_batch(one, path)
    with pytest.raises(ValueError, match="does not fit"):
        audit.append_batch(one.withColumn("notes", F.lit(1)), path, batch_id="b4")


def test_append_with_a_batch_id(spark, scratch):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for batch in ("x", "y", "x"):
        tables.append(rows, f"{scratch}/t", batch_id=batch)
    assert sorted((r.k, r.batch_id) for r in spark.read.parquet(f"{scratch}/t").collect()) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
