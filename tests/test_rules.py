"""Rule ladders: recommendations (RC-*), next contact, scheduling (SC-*)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from receivables.operators import recommend, schedule

AS_OF = dt.date(2001, 6, 30)


def test_action_ladder_edges(spark):
    rows = []
    for d in [0, 3, 4, 10, 11, 20, 21, 45, 46]:
        for p in [0, 1, 2, 5]:
            for hv in [False, True]:
                rows.append((d, 50, p, hv))
    df = spark.createDataFrame(rows, "d int, r int, p int, hv boolean")
    got = {(r.d, r.p, r.hv): r.a for r in df.select("d", "p", "hv", recommend.determine_action("d", "r", "p", "hv").alias("a")).collect()}
    assert got[(0, 0, False)] == "final_notice"  # D9: not due, low risk falls through to the 45+ branch
    assert got[(0, 0, True)] == "escalate"
    assert got[(3, 0, False)] == "friendly_reminder" and got[(3, 1, False)] == "second_reminder"
    assert got[(4, 0, False)] == "reminder_with_inquiry" and got[(10, 2, False)] == "call"
    assert got[(11, 0, False)] == "firm_reminder" and got[(20, 0, True)] == "call"
    assert got[(21, 1, False)] == "payment_plan_offer" and got[(45, 2, False)] == "pause_service_warning"
    assert got[(46, 0, False)] == "final_notice" and got[(46, 0, True)] == "escalate"
    assert all(got[(d, 5, hv)] == "escalate" for d in [0, 3, 46] for hv in [False, True])


def test_not_due_high_risk_and_option(spark):
    df = spark.createDataFrame([(0, 70, 0, False), (0, 69, 0, False)], "d int, r int, p int, hv boolean")
    got = [r[0] for r in df.select(recommend.determine_action("d", "r", "p", "hv", not_due_action="monitor")).collect()]
    assert got == ["friendly_reminder", "monitor"]


def test_priority_urgency_tone(spark):
    df = spark.createDataFrame([(90, 100, 50000.0, 5, True), (0, 50, 9999.0, 0, False), (30, 0, 0.0, 2, False)],
                               "d int, r int, a double, p int, hv boolean")
    out = df.select(recommend.priority("d", "r", "a", "p").alias("pr"), recommend.tone("d", "p", "hv").alias("t")).collect()
    assert [r.pr for r in out] == [100, 18, 17]
    assert [r.t for r in out] == ["firm", "friendly", "firm"]
    u = spark.createDataFrame([(75,), (74,), (50,), (25,), (24,)], "p int").select(recommend.urgency("p")).collect()
    assert [r[0] for r in u] == ["critical", "high", "high", "medium", "low"]


def test_next_contact(spark):
    scored = spark.createDataFrame(
        [("I1", "C1", dt.date(2001, 6, 25), 40), ("I2", "C1", dt.date(2001, 6, 20), 60),
         ("I3", "C1", dt.date(2001, 6, 10), 75), ("I4", "C1", dt.date(2001, 3, 1), 10),
         ("I5", "C1", dt.date(2001, 5, 1), 95), ("I6", "C1", dt.date(2001, 5, 20), 40)],
        "invoice_id string, customer_id string, due_date date, risk_score int")
    log = spark.createDataFrame(
        [("I2", "friendly_reminder"), ("I3", "second_notice"), ("I6", "a"), ("I6", "b")], "invoice_id string, action_type string")
    got = {r.invoice_id: r.next_action for r in recommend.next_contact(scored, log, AS_OF).collect()}
    assert got == {"I1": "friendly_reminder", "I2": "second_notice", "I3": "call_request", "I4": "escalate",
                   "I5": "escalate", "I6": "call_request"}


def test_business_roll_with_holidays(spark):
    # Friday 2001-07-06 + 1 day = Saturday -> Monday 07-09, a holiday -> Tuesday 07-10.
    hol = schedule.holiday_table(spark, [dt.date(2001, 7, 9)])
    cal = schedule.business_calendar(spark, dt.date(2001, 7, 1), dt.date(2001, 7, 20), hol)
    df = spark.createDataFrame([(dt.date(2001, 7, 7),), (dt.date(2001, 7, 4),)], "d date")
    got = [r.d for r in schedule.roll_to_business_day(df, "d", cal).orderBy("d").collect()]
    assert got == [dt.date(2001, 7, 4), dt.date(2001, 7, 10)]


def test_schedule_expansion_and_weekends(spark):
    targets = spark.createDataFrame(
        [("I1", "C1", "low", 0), ("I2", "C2", "very_high", 40), ("I3", "C3", "weird", 0), ("I4", "C4", None, 0)],
        "invoice_id string, customer_id string, risk_category string, days_overdue int")
    hol = schedule.holiday_table(spark, [dt.date(2001, 7, 4), dt.date(2001, 7, 5)])
    s = schedule.generate_schedule(targets, AS_OF, hol).cache()
    counts = {r.invoice_id: r["count"] for r in s.groupBy("invoice_id").count().collect()}
    assert counts == {"I1": 4, "I2": 7, "I3": 5, "I4": 5}
    assert s.where(F.weekday("scheduled_date") >= 5).count() == 0
    assert s.where(F.col("scheduled_date").isin(dt.date(2001, 7, 4), dt.date(2001, 7, 5))).count() == 0
    i2 = {r.attempt_number: r.action_type for r in s.where("invoice_id = 'I2'").collect()}
    assert i2[1] == "friendly_reminder" and i2[2] == "second_notice" and i2[3] == "call_request"
    assert i2[4] == "escalate" and i2[5] == "call_request" and i2[6] == "payment_plan"
    first = s.where("invoice_id = 'I2' AND attempt_number = 1").first()
    assert first.scheduled_date == dt.date(2001, 7, 2)  # Sunday 07-01 rolls to Monday
    capped = schedule.generate_schedule(targets, AS_OF, hol, max_attempts=2)
    assert capped.count() == 8


def test_schedule_mutations(spark):
    targets = spark.createDataFrame([("I1", "C1", "low", 0)], "invoice_id string, customer_id string, risk_category string, days_overdue int")
    s = schedule.generate_schedule(targets, AS_OF)
    upd = spark.createDataFrame([("I1", 1, dt.date(2001, 7, 7), "asked")], "invoice_id string, attempt_number int, new_date date, reason string")
    r = schedule.reschedule(s, upd).where("attempt_number = 1").first()
    assert r.scheduled_date == dt.date(2001, 7, 9) and r.reschedule_reason == "asked"
    done = spark.createDataFrame([("I1", 2, dt.date(2001, 7, 15), "ok")], "invoice_id string, attempt_number int, completed_date date, notes string")
    c = schedule.mark_completed(s, done)
    assert c.where("status = 'completed'").count() == 1
    paid = spark.createDataFrame([("I1",)], "invoice_id string")
    x = schedule.cancel_future_actions(c, paid, AS_OF)
    assert {r.status for r in x.collect()} == {"completed", "cancelled"}
    eff = schedule.schedule_effectiveness(x, paid).first()
    assert (eff.total_actions, eff.completed_actions, eff.cancelled_actions, eff.pending_actions) == (4, 1, 3, 0)
    assert eff.avg_attempts_to_payment == 4.0 and eff.action_type_distribution == "second_notice:1"


def test_schedule_rolls_past_a_long_closure(spark):
    """Holidays on every day for 60 days: every attempt lands on the first business day after them."""
    targets = spark.createDataFrame([("I1", "C1", "medium", 10)], "invoice_id string, customer_id string, risk_category string, days_overdue int")
    closed = schedule.holiday_table(spark, [dt.date(2001, 7, 1) + dt.timedelta(days=k) for k in range(60)])
    rows = schedule.generate_schedule(targets, dt.date(2001, 6, 30), closed).collect()
    assert {r.scheduled_date for r in rows} == {dt.date(2001, 8, 30)} and len(rows) == 5
    moved = schedule.reschedule(
        schedule.generate_schedule(targets, dt.date(2001, 6, 30)),
        spark.createDataFrame([("I1", 1, dt.date(2001, 7, 3), "x")], "invoice_id string, attempt_number int, new_date date, reason string"), closed,
    )
    assert moved.where("attempt_number = 1").first().scheduled_date == dt.date(2001, 8, 30)


def test_calendar_limits(spark):
    cal = schedule.business_calendar(spark, dt.date(2001, 7, 2), dt.date(2001, 7, 6))
    df = spark.createDataFrame([(dt.date(2002, 7, 3),)], "d date")
    with pytest.raises(Exception, match="no business day known"):
        schedule.roll_to_business_day(df, "d", cal).collect()
    s = schedule.generate_schedule(spark.createDataFrame([("I1", "C1", "low", 1)], "invoice_id string, customer_id string, risk_category string, days_overdue int"), dt.date(2001, 6, 30))
    bad = spark.createDataFrame([("I1", 1, dt.date(2001, 7, 3), "x"), ("I1", 2, dt.date(9999, 12, 31), "y")], "invoice_id string, attempt_number int, new_date date, reason string")
    with pytest.raises(Exception, match="the dates span more than"):
        schedule.reschedule(s, bad).collect()


def test_repeated_updates_apply_once_the_last_wins(spark):
    s = schedule.generate_schedule(spark.createDataFrame([("I1", "C1", "low", 1)], "invoice_id string, customer_id string, risk_category string, days_overdue int"), dt.date(2001, 6, 30))
    upd = spark.createDataFrame(
        [("I1", 1, dt.date(2001, 8, 6), "first", 1), ("I1", 1, dt.date(2001, 7, 9), None, 2)], "invoice_id string, attempt_number int, new_date date, reason string, sequence int"
    )
    rows = schedule.reschedule(s, upd).collect()
    one = next(r for r in rows if r.attempt_number == 1)
    assert len(rows) == s.count() and one.scheduled_date == dt.date(2001, 7, 9) and one.reschedule_reason == "first"
    done = spark.createDataFrame([("I1", 2, dt.date(2001, 7, 1), "a", 2), ("I1", 2, dt.date(2001, 7, 20), "b", 1)], "invoice_id string, attempt_number int, completed_date date, notes string, sequence int")
    rows = schedule.mark_completed(s, done).collect()
    two = next(r for r in rows if r.attempt_number == 2)
    assert len(rows) == s.count() and (two.completed_date, two.completion_notes) == (dt.date(2001, 7, 1), "a")
