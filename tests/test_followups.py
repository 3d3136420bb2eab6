"""Follow-ups as a stream: the batch operators' schedule in any order of arrival, timers, replans, late events."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from receivables.operators import schedule
from receivables.sources import tables
from receivables.session import checkpoint_folder
from receivables.streaming import cancellations, followups, shards

D = dt.date(2001, 6, 29)
day = lambda n: D + dt.timedelta(days=n)
at = lambda n: dt.datetime.combine(day(n), dt.time(9))
HOLIDAYS = [dt.date(2001, 7, 4), dt.date(2001, 7, 5), dt.date(2001, 7, 6)]


def put(spark, rows, schema, folder):
    tables.save(spark.createDataFrame(rows, schema).coalesce(1), folder, mode="append")


def run(spark, folder, holidays=None, **more):
    followups.start(spark, *(f"{folder}/{x}" for x in ("targets", "updates", "payments", "changes")), holidays=holidays, **more).awaitTermination()
    return spark.read.schema(followups.CHANGES).parquet(f"{folder}/changes")


def feed(spark, folder, targets=(), updates=(), payments=()):
    put(spark, list(targets), followups.TARGET_EVENTS, f"{folder}/targets")
    put(spark, list(updates), followups.UPDATE_EVENTS, f"{folder}/updates")
    put(spark, list(payments), cancellations.PAYMENT_EVENT_SCHEMA, f"{folder}/payments")


def move(i, attempt, seq, to, why=None, when=1):
    return (i, attempt, followups.MOVED, seq, to, why, None, None, at(when))


def done(i, attempt, seq, on, notes=None, when=1):
    return (i, attempt, followups.DONE, seq, None, None, on, notes, at(when))


def events(seed):
    r = random.Random(seed)
    targets = [(f"I{k:02}", f"C{k % 7}" if k % 5 else None, ["low", "medium", "high", "very_high", "odd", None][k % 6], [None, 0, 20, 70][k % 4], D) for k in range(40)]
    ids = [t[0] for t in targets] + ["unknown"]
    updates = []
    for _ in range(150):
        i, attempt, seq = r.choice(ids), r.randint(0, 9), r.choice([None, 1, 2, 3])
        if r.random() < 0.5:
            updates.append(move(i, attempt, seq, r.choice([None, day(r.randint(0, 60))]), r.choice([None, "asked", "ßé", "away"])))
        else:
            updates.append(done(i, attempt, seq, r.choice([None, day(r.randint(0, 20))]), r.choice([None, "", "voicemail"])))
    payments = [(f"P{k}", r.choice(ids), r.choice([None, day(r.randint(-30, 20))]), 5.0, "ach", "completed") for k in range(25)]
    return targets, updates, payments


def batch_schedule(spark, targets, updates, payments, holidays):
    t = spark.createDataFrame([x[:4] for x in targets], "invoice_id string, customer_id string, risk_category string, days_overdue int")
    u = spark.createDataFrame(updates, followups.UPDATE_EVENTS)
    plan = schedule.generate_schedule(t, D, holidays)
    moves = u.where(F.col("kind") == followups.MOVED).select("invoice_id", "attempt_number", "sequence", "new_date", "reason")
    ends = u.where(F.col("kind") == followups.DONE).select("invoice_id", "attempt_number", "sequence", "completed_date", "notes")
    plan = schedule.mark_completed(schedule.reschedule(plan, moves, holidays), ends)
    paid = cancellations.cancellation_rows(spark.createDataFrame(payments, cancellations.PAYMENT_EVENT_SCHEMA), plan)
    return cancellations.apply_cancellations(plan, paid)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_schedule(spark, scratch, seed):
    targets, updates, payments = events(seed)
    holidays = schedule.holiday_table(spark, HOLIDAYS)
    want = sorted(map(repr, batch_schedule(spark, targets, updates, payments, holidays).select(*schedule.SCHEDULE_COLUMNS).collect()))
    mixed = [(kind, row) for kind, rows in enumerate((targets, updates, payments)) for row in rows]
    random.Random(seed + 10).shuffle(mixed)
    for n in range(2):  # a restart between
        half = mixed[n::2] + mixed[:5]  # some rows are delivered twice
        feed(spark, scratch, *([row for k, row in half if k == kind] for kind in range(3)))
        found = run(spark, scratch, holidays, late_days=4000, files_per_batch=1)
    assert sorted(map(repr, followups.current(found).collect())) == want
    before = found.count()
    assert run(spark, scratch, holidays, late_days=4000).count() == before  # nothing new arrived: nothing is repeated


def test_types_are_the_batch_operators(spark):
    t = spark.createDataFrame([], "invoice_id string, customer_id string, risk_category string, days_overdue int")
    found = followups.current(spark.createDataFrame([], followups.CHANGES))
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schedule.generate_schedule(t, D).schema]


def test_attempts_fall_due_once_and_only_while_pending(spark, scratch):
    # Low: attempts on days 7, 14, 21 and 30 after the Friday D, rolled past weekends.
    feed(spark, scratch, [("A", "C", "low", 0, D), ("B", "C", "low", 0, D)], [done("A", 1, 1, day(5), when=5), move("B", 2, 1, day(27), "later", when=5)])
    run(spark, scratch, late_days=1)
    clock = lambda n: feed(spark, scratch, payments=[(f"T{n}", "clock", day(n), 1.0, "ach", "completed")])
    clock(16)
    got = {tuple(r)[:3] for r in followups.due(run(spark, scratch, late_days=1)).collect()}
    assert got == {("B", 1, day(7)), ("A", 2, day(14))}
    feed(spark, scratch, payments=[("P", "A", day(17), 1.0, "ach", "completed")])  # A has nothing pending any more
    run(spark, scratch, late_days=1)
    clock(40)
    rows = followups.due(run(spark, scratch, late_days=1)).collect()
    assert sorted(tuple(r)[:3] for r in rows) == [("A", 2, day(14)), ("B", 1, day(7)), ("B", 2, day(28 - 1 + 2 * (day(27).weekday() == 5))), ("B", 3, day(21)), ("B", 4, day(31))]


def test_a_later_contact_replaces_the_plan(spark, scratch):
    feed(spark, scratch, [("A", "C", "very_high", 0, D)])
    run(spark, scratch)
    feed(spark, scratch, [("A", "C", "low", 0, day(3)), ("A", "C", "high", 0, day(-3))])
    rows = followups.current(run(spark, scratch)).collect()
    assert sorted((r.attempt_number, r.days_from_last_contact) for r in rows) == [(1, 7), (2, 14), (3, 21), (4, 30)]


def test_late_events_and_dropped_states(spark, scratch):
    feed(spark, scratch, [("A", "C", "low", 0, D), ("B", "C", "low", 0, D), (None, "C", "low", 0, D)], [done("N", 1, 1, D)])
    run(spark, scratch, late_days=10, keep_days=20)
    feed(spark, scratch, payments=[("T", "clock", day(200), 1.0, "ach", "completed")])
    run(spark, scratch, late_days=10, keep_days=20)
    feed(spark, scratch, [("N", "C", "low", 0, day(195))], [done("A", 1, 9, D, when=100)])  # the second is beyond the watermark
    rows = followups.current(run(spark, scratch, late_days=10, keep_days=20)).collect()
    assert {r.invoice_id for r in rows} == {"A", "B", "N"} and {r.status for r in rows} == {"pending"}


def test_calls_do_not_grow_with_the_invoices(spark, scratch, monkeypatch):
    """Many invoices share a call of the stateful step; each keeps its own state, timers and drop."""
    monkeypatch.setattr(shards, "SHARDS", 3)
    sequence = 2**53 + 1  # not exact as a float
    targets = [(f"I\t{k}\n\"é", f"C{k}", "low", 0, D) for k in range(60)]
    feed(spark, scratch, targets[:40], [done(t[0], 2, n, day(6 - n % 2)) for t in targets[::2] for n in (sequence, sequence - 1)])
    run(spark, scratch, late_days=30)
    name = f"followups-{hashlib.sha1(f'{scratch}/changes'.encode()).hexdigest()[:12]}"
    assert 0 < spark.read.format("statestore").load(os.path.join(checkpoint_folder(spark), "streams", name)).count() <= 3
    feed(spark, scratch, targets[40:], payments=[("P", targets[1][0], day(3), 1.0, "ach", "completed")])
    found = run(spark, scratch, late_days=30)
    rows = {(r.invoice_id, r.attempt_number): r for r in followups.current(found).collect()}
    assert len(rows) == 60 * 4 and {r.status for k, r in rows.items() if k[0] == targets[1][0]} == {"cancelled"}
    assert all(rows[t[0], 2].completed_date == day(5) for t in targets[::2])
