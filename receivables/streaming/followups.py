"""SC-1, SC-2, SC-6..8 as a stream: follow-up schedules that live as state per invoice.

Targets (a last contact), updates (an attempt moved or completed) and payments arrive as files, in any order and any
micro-batch. The state of an invoice holds its planned attempts, the last update of each attempt and the first payment: a
merge of maxima and minima, so every order of arrival ends in the same schedule, the one that the batch operators give for the
same rows (``generate_schedule``, ``reschedule``, ``mark_completed``, then ``apply_cancellations``). Each attempt that an arrival
changes is appended to a parquet table as a whole row with a growing ``version``; ``current`` keeps the last one.

A timer per invoice stands at its next pending attempt: when the watermark passes the start of that day, the attempt is
appended once more as event ``due``. An attempt that was completed, cancelled or moved before is not due; a moved one is due again
on its new day.

Attempts are the cadence's, so the state of an invoice is bounded however many updates and payments it has: updates of attempt
numbers beyond the longest cadence go before the state. The state of an invoice without an attempt still to fall due is dropped
``keep_days`` after the latest event that it has seen; updates of an invoice whose target never comes go with it.

A call of the stateful step costs milliseconds whatever it does, so invoices are kept in ``shards.SHARDS`` shards by a hash of
their id: a call takes all arrivals and timers of a shard, invoice by invoice, and only these invoices' states are decoded.

Defined results: of several targets of an invoice the one with the latest contact counts (ties: more days overdue, then the
larger risk and customer), attempts that only an older one had are no longer listed; repeated rows change nothing; rows without
invoice or event time are left out; a payment without a date cancels nothing; events older than the watermark (``late_days``
behind the latest event) are dropped.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from receivables.functions.stored import workers_find_package
from receivables.operators import schedule
from receivables.session import checkpoint_folder
from receivables.streaming import shards
from receivables.streaming.cancellations import PAYMENT_EVENT_SCHEMA, REASON

TARGET_EVENTS = "invoice_id string, customer_id string, risk_category string, days_overdue int, last_contact date"
UPDATE_EVENTS = (
    "invoice_id string, attempt_number int, kind string, sequence long, new_date date, reason string, completed_date date, notes string, at timestamp_ntz"
)
MOVED, DONE = "reschedule", "complete"  # kinds of updates
CHANGES = (
    "invoice_id string, customer_id string, attempt_number int, scheduled_date date, action_type string, days_from_last_contact int, "
    "estimated_days_overdue int, status string, reschedule_reason string, completed_date date, completion_notes string, "
    "cancellation_reason string, cancelled_date date, event string, version long"
)
# The sequence is sent as text: pandas would make numbers with gaps inexact.
EVENT_COLUMNS = {
    "invoice_id": "string", "seconds": "long", "kind": "string", "attempt_number": "int", "sequence": "string", "day": "int", "asked_day": "int", "said": "string",
    "contact": "int", "overdue": "int", "risk": "string", "customer_id": "string", "action_type": "string", "days_offset": "int",
}
DAY_MS = 86_400_000


def rolled(df: DataFrame, date_col: str, holidays: DataFrame | None) -> DataFrame:
    """``date_col`` moved to the first business day on or after it. Only days around holidays are looked up: all other
    weekends follow from the date, so no date lies outside the calendar."""
    day = F.col(date_col)
    monday = F.when(F.weekday(day) == 5, F.date_add(day, 2)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)
    if holidays is None:
        return df.withColumn(date_col, monday)
    span = holidays.agg(F.date_sub(F.min("holiday"), 7).alias("lo"), F.max("holiday").alias("hi"))
    # One row per day of the holidays' span, checked against schedule.MAX_CALENDAR_DAYS.
    near = F.broadcast(schedule._calendar(span, holidays).withColumnRenamed("day", "__day"))
    return df.join(near, day == F.col("__day"), "left").withColumn(date_col, F.coalesce("next_business_day", monday)).drop("__day", "next_business_day")


def _seconds(time: Column) -> Column:
    """Seconds from 1970 of a date or a time without zone, the same in every session zone."""
    time = time.cast("timestamp_ntz")
    return F.unix_date(F.to_date(time)).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def _events(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in EVENT_COLUMNS.items()])


def events(targets: DataFrame, updates: DataFrame, payments: DataFrame, holidays: DataFrame | None, cadences: dict[str, list[int]]) -> DataFrame:
    """One schema for the three streams. Targets are expanded to their dated attempts here, moves get their business day."""
    known = F.when(F.col("risk_category").isin(list(cadences)), F.col("risk_category")).otherwise(F.lit("medium"))
    plan = targets.withColumn("risk", F.coalesce("risk_category", F.lit("medium"))).withColumn("risk_level", known)
    plan = plan.withColumn("overdue", F.coalesce("days_overdue", F.lit(0)))
    plan = plan.join(F.broadcast(schedule.cadence_table(plan.sparkSession, cadences)), "risk_level")
    plan = rolled(plan.withColumn("__date", F.date_add("last_contact", F.col("days_offset"))), "__date", holidays)
    c = F.col
    planned = _events(
        plan, invoice_id=c("invoice_id"), seconds=_seconds(c("last_contact")), kind=F.lit("plan"), attempt_number=c("attempt_number"), day=F.unix_date("__date"),
        contact=F.unix_date("last_contact"), overdue=c("overdue"), risk=c("risk"), customer_id=c("customer_id"),
        action_type=schedule.action_type("attempt_number", c("overdue") + c("days_offset"), "risk"), days_offset=c("days_offset"),
    )
    longest = max(len(days) for days in cadences.values())
    some = rolled(updates.where(c("attempt_number").between(1, longest)).withColumn("__date", c("new_date")), "__date", holidays)
    moved = c("kind") == MOVED
    updated = _events(
        some.where(c("kind").isin(MOVED, DONE)), invoice_id=c("invoice_id"), seconds=_seconds(c("at")), kind=c("kind"), attempt_number=c("attempt_number"), sequence=c("sequence"),
        day=F.unix_date(F.when(moved, c("__date")).otherwise(c("completed_date"))), asked_day=F.unix_date(F.when(moved, c("new_date")).otherwise(c("completed_date"))),
        said=F.when(moved, c("reason")).otherwise(c("notes")),
    )
    paid = _events(payments, invoice_id=c("invoice_id"), seconds=_seconds(c("payment_date")), kind=F.lit("pay"), day=F.unix_date("payment_date"))
    every = planned.unionByName(updated).unionByName(paid).where(c("invoice_id").isNotNull() & c("seconds").isNotNull())
    return every.withColumn("at", F.timestamp_seconds("seconds"))  # midnight of a day is the same in attempts and event times


class Event(NamedTuple):
    kind: str
    attempt_number: int | None
    sequence: int | None
    day: int | None
    asked_day: int | None
    said: str | None
    contact: int | None
    overdue: int | None
    risk: str | None
    customer_id: str | None
    action_type: str | None
    days_offset: int | None


def _plain(values: pd.DataFrame) -> Iterator[tuple[str, int, Event]]:
    """(invoice, seconds, event) of the rows, with missing values as None and whole numbers as int, whatever type pandas gave the
    column."""
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) else v
    columns = {name: list(map(plain, values[name].tolist())) for name in Event._fields}
    columns["sequence"] = [None if v is None else int(v) for v in columns["sequence"]]
    yield from zip(values["invoice_id"].tolist(), values["seconds"].tolist(), map(Event._make, zip(*columns.values(), strict=True)), strict=True)


def _known(value) -> list:
    """A value that may be missing, so that lists of them compare as Spark's structs do (missing first)."""
    return [0] if value is None else [1, value]


def _merge(memory: dict, e: Event) -> None:
    """Take one event into an invoice's state. Every step is a maximum or minimum: the order of events does not matter."""
    if e.kind == "plan":
        key = [e.contact, e.overdue, e.risk, _known(e.customer_id)]
        if memory["key"] is None or key > memory["key"]:
            memory["key"], memory["plan"] = key, {}
        if key == memory["key"]:
            memory["plan"][str(e.attempt_number)] = [e.day, e.action_type, e.days_offset]
    elif e.kind == "pay":
        if memory["paid"] is None or e.day < memory["paid"]:
            memory["paid"] = e.day
    else:
        held = memory["updates"].setdefault(f"{e.kind}-{e.attempt_number}", {})
        order = [_known(e.sequence), _known(e.asked_day), _known(e.said)]
        for name, value in (("day", e.day), ("said", e.said)):
            if value is not None and (name not in held or order > held[name][0]):
                held[name] = [order, value]


def _rows(memory: dict) -> dict[str, list]:
    """attempt -> what ``CHANGES`` says of it, but for the invoice, the event and the version; dates as days."""
    out = {}
    for attempt, (day, action, offset) in memory["plan"].items():
        moved, done = (memory["updates"].get(f"{kind}-{attempt}") for kind in (MOVED, DONE))
        reason = None
        if moved and "day" in moved:
            day, reason = moved["day"][1], moved.get("said", [None, None])[1]
        status, finished, notes, why, cancelled = "pending", None, None, None, None
        if done is not None:
            status, finished, notes = "completed", done.get("day", [None, None])[1], done.get("said", [None, None])[1]
        elif memory["paid"] is not None:
            status, why, cancelled = "cancelled", REASON, memory["paid"]
        _, overdue, _, customer = memory["key"]
        out[attempt] = [customer[-1] if customer[0] else None, int(attempt), day, action, offset, overdue + offset, status, reason, finished, notes, why, cancelled]
    return out


DATES = (2, 8, 11)  # of ``_rows``
EPOCH = dt.date(1970, 1, 1)


def _dated(row: list) -> list:
    return [EPOCH + dt.timedelta(days=v) if k in DATES and v is not None else v for k, v in enumerate(row)]


def follow(memory: dict, arrived: list[Event], latest: int, watermark: int, keep_ms: int) -> tuple[list[list], int | None]:
    """Take an invoice's arrivals into ``memory``: rows of the attempts that they change and of those that fall due, and the time
    at which to look again (None: the invoice can be forgotten)."""
    before = _rows(memory)
    memory["latest"] = max(memory["latest"], latest)
    for event in arrived:
        _merge(memory, event)
    after = _rows(memory) if arrived else before
    # A state that comes anew after an old one was dropped goes on with larger versions: the watermark has moved on.
    version = max(memory["version"] + 1, watermark)
    out = [[*row, "changed"] for attempt, row in after.items() if before.get(attempt) != row]
    out += [[*row[:6], "replaced", *row[7:], "changed"] for attempt, row in before.items() if attempt not in after]
    timers = []
    for attempt, row in after.items():
        if row[6] == "pending" and memory["told"].get(attempt) != row[2]:
            if row[2] * DAY_MS < watermark:
                memory["told"][attempt] = row[2]
                out.append([*row, "due"])
            else:
                timers.append(row[2] * DAY_MS)
    if out:
        memory["version"] = version
    rows = [[*_dated(row), version] for row in out]
    if not timers and memory["latest"] + keep_ms < watermark:
        return rows, None
    return rows, max(min(timers, default=memory["latest"] + keep_ms), watermark) + 1


def changes(keep_ms: int):
    """The stateful step: whole rows of the attempts that an arrival changes, and of those that fall due, for a shard of invoices."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark = shards.entries(state), state.getCurrentWatermarkMs()
        asked: dict[str, tuple[list[Event], int]] = {invoice: ([], 0) for invoice, (timer, _) in held.items() if timer < watermark}
        for batch in batches:
            for invoice, seconds, event in _plain(batch) if len(batch) else ():  # a timer's call has no rows
                arrived, latest = asked.get(invoice) or ([], 0)
                arrived.append(event)
                asked[invoice] = arrived, max(latest, seconds * 1000)
        out = []
        for invoice, (arrived, latest) in asked.items():
            memory = json.loads(held[invoice][1]) if invoice in held else {"key": None, "plan": {}, "updates": {}, "paid": None, "told": {}, "version": 0, "latest": 0}
            rows, timer = follow(memory, arrived, latest, watermark, keep_ms)
            out += [[invoice, *row] for row in rows]
            if timer is None:
                held.pop(invoice, None)
            else:
                held[invoice] = timer, json.dumps(memory)
        shards.keep(state, held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")], dtype=object)

    return step


def start(spark: SparkSession, targets_dir: str, updates_dir: str, payments_dir: str, sink_dir: str, holidays: DataFrame | None = None,
          cadences: dict[str, list[int]] | None = None, late_days: int = 30, keep_days: int = 400, name: str = "followups", available_now: bool = True,
          files_per_batch: int = 1000) -> StreamingQuery:
    """Run the stream into ``sink_dir`` (checkpoint under ``spark.checkpoint.dir``)."""
    workers_find_package(spark)
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    arrived = events(
        read(TARGET_EVENTS, targets_dir), read(UPDATE_EVENTS, updates_dir), read(PAYMENT_EVENT_SCHEMA, payments_dir), holidays, cadences or schedule.CADENCES
    )
    stated = arrived.withWatermark("at", f"{late_days} days").withColumn("shard", shards.shard("invoice_id")).groupBy("shard")
    out = stated.applyInPandasWithState(changes(keep_days * DAY_MS), CHANGES, shards.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    key = hashlib.sha1(sink_dir.encode()).hexdigest()[:12]
    place = os.path.join(checkpoint_folder(spark), "streams", f"{name}-{key}")
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", place).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.queryName(f"{name}-{key}").start()


def current(found: DataFrame) -> DataFrame:
    """The schedule after all changes so far; columns as in ``schedule.generate_schedule``."""
    columns = [c for c in schedule.SCHEDULE_COLUMNS if c not in ("invoice_id", "attempt_number")]
    last = found.where(F.col("event") == "changed").groupBy("invoice_id", "attempt_number").agg(F.max_by(F.struct(*columns), "version").alias("last"))
    return last.where(F.col("last.status") != "replaced").select("invoice_id", "attempt_number", "last.*").select(*schedule.SCHEDULE_COLUMNS)


def due(found: DataFrame) -> DataFrame:
    """(invoice_id, attempt_number, scheduled_date, action_type) of every attempt that fell due."""
    return found.where(F.col("event") == "due").select("invoice_id", "attempt_number", "scheduled_date", "action_type")
