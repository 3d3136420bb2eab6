"""Streaming SC-8: payments files -> cancellation rows -> schedule update."""

import datetime as dt
import os

from receivables.operators import schedule
from receivables.streaming import cancellations


def test_payment_stream_cancels_pending(spark, scratch):
    targets = spark.createDataFrame([("I1", "C1", "low", 0), ("I2", "C2", "high", 10)],
                                    "invoice_id string, customer_id string, risk_category string, days_overdue int")
    sched = schedule.generate_schedule(targets, dt.date(2001, 6, 30))
    done = spark.createDataFrame([("I1", 1, dt.date(2001, 7, 9), "ok")],
                                 "invoice_id string, attempt_number int, completed_date date, notes string")
    sched = schedule.mark_completed(sched, done).cache()
    pay_dir, sink = os.path.join(scratch, "pay"), os.path.join(scratch, "sink")
    spark.createDataFrame([("P1", "I1", dt.date(2001, 7, 10), 10.0, "ach", "completed")],
                          cancellations.PAYMENT_EVENT_SCHEMA).write.parquet(os.path.join(pay_dir, "b1"))
    q = cancellations.start(spark, os.path.join(pay_dir, "*"), sched, sink, name="t_cancel")
    q.awaitTermination(120)
    rows = spark.read.parquet(sink)
    assert sorted(r.attempt_number for r in rows.collect()) == [2, 3, 4]
    updated = cancellations.apply_cancellations(sched, rows)
    got = {(r.invoice_id, r.attempt_number): r.status for r in updated.collect()}
    assert got[("I1", 1)] == "completed" and got[("I1", 2)] == "cancelled" and got[("I2", 1)] == "pending"
    cut = [r for r in updated.collect() if r.status == "cancelled"]
    assert {(r.cancelled_date, r.cancellation_reason) for r in cut} == {(dt.date(2001, 7, 10), cancellations.REASON)}
    again = cancellations.apply_cancellations(updated, rows)  # idempotent
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, updated.collect()))


def test_restart_processes_only_new_files(spark, scratch):
    targets = spark.createDataFrame([("I1", "C1", "low", 0), ("I2", "C2", "low", 0)],
                                    "invoice_id string, customer_id string, risk_category string, days_overdue int")
    sched = schedule.generate_schedule(targets, dt.date(2001, 6, 30)).cache()
    pay_dir, sink = os.path.join(scratch, "pay2"), os.path.join(scratch, "sink2")
    rows = lambda inv: spark.createDataFrame(
        [("P-" + inv, inv, dt.date(2001, 7, 10), 10.0, "ach", "completed")], cancellations.PAYMENT_EVENT_SCHEMA)
    rows("I1").write.parquet(os.path.join(pay_dir, "b1"))
    cancellations.start(spark, os.path.join(pay_dir, "*"), sched, sink, name="t_restart").awaitTermination(120)
    first = spark.read.parquet(sink).count()
    rows("I2").write.parquet(os.path.join(pay_dir, "b2"))
    # Same query name and sink: the checkpoint resumes, so only the new file's payment is processed.
    cancellations.start(spark, os.path.join(pay_dir, "*"), sched, sink, name="t_restart").awaitTermination(120)
    out = spark.read.parquet(sink)
    assert first == 4 and out.count() == 8
    assert out.groupBy("invoice_id", "attempt_number").count().where("count > 1").count() == 0
