"""Follow-up scheduling (SC-1..SC-11) with a cadence dimension and a business-day calendar dimension.

Per-invoice loops become joins: each open invoice joins the (broadcast, fixed-size) cadence table to expand into its
attempts, and each attempt's target date joins the (broadcast, date-span-sized) calendar to roll forward past
weekends and holidays. Mutations (reschedule / complete / cancel) take an updates DataFrame and apply in one join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from receivables.functions import expr as E

# Follow-up cadences (days after the last contact) per risk level.
CADENCES = {
    "low": [7, 14, 21, 30],
    "medium": [5, 10, 15, 22, 30],
    "high": [3, 7, 10, 14, 17, 21],
    "very_high": [1, 3, 5, 7, 9, 12, 15],
}

SCHEDULE_COLUMNS = [
    "invoice_id", "customer_id", "attempt_number", "scheduled_date", "action_type", "days_from_last_contact",
    "estimated_days_overdue", "status", "reschedule_reason", "completed_date", "completion_notes",
    "cancellation_reason", "cancelled_date",
]


def cadence_table(spark: SparkSession, cadences: dict[str, list[int]] | None = None) -> DataFrame:
    """(risk_level, attempt_number, days_offset): one row per attempt of each cadence."""
    rows = [(lvl, i + 1, d) for lvl, days in (cadences or CADENCES).items() for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "risk_level string, attempt_number int, days_offset int")


def holiday_table(spark: SparkSession, dates: list[dt.date] | None = None) -> DataFrame:
    return spark.createDataFrame([(d,) for d in (dates or [])], "holiday date")


# The longest span of dates that a calendar is built for: it is broadcast, so one bad date must not stretch it.
MAX_CALENDAR_DAYS = 36_525


def _calendar(span: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """(day, next_business_day) from ``lo`` to beyond ``hi`` of the one-row ``span``; business = weekday, no holiday.

    k holidays close at most k weekdays, and k // 5 + 2 weeks hold more than k of them, so the calendar always reaches
    a business day after ``hi``, however long a closure is. Its size is bounded by the span and the holiday table.
    """
    too_long = F.raise_error(F.lit(f"the dates span more than {MAX_CALENDAR_DAYS} days"))
    bounded = F.when(F.datediff("hi", "lo") > MAX_CALENDAR_DAYS, too_long.cast("date")).otherwise(F.col("hi"))
    span = span.select("lo", bounded.alias("hi"))
    if holidays is None:
        span = span.withColumn("k", F.lit(0))
    else:
        closed = holidays.select(F.col("holiday").alias("day")).where(F.col("day").isNotNull()).distinct()
        span = span.crossJoin(closed.agg(F.count(F.lit(1)).alias("k")))
    days = span.select(F.explode(F.sequence("lo", F.date_add("hi", (7 * (F.floor(F.col("k") / 5) + 2)).cast("int")))).alias("day"))
    biz = F.weekday("day") < 5
    if holidays is not None:
        days = days.join(closed.withColumn("is_holiday", F.lit(True)), "day", "left")
        biz = biz & F.col("is_holiday").isNull()
    # One small row per day of the span: the unpartitioned window is a bounded task.
    w = Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return days.select("day", F.min(F.when(biz, F.col("day"))).over(w).alias("next_business_day"))


def business_calendar(spark: SparkSession, start, end, holidays: DataFrame | None = None) -> DataFrame:
    """(day, next_business_day) for every day from ``start`` to ``end`` and on to the next business day after it.

    The calendar size is the date span in days (not the data size), so it is safe to broadcast. The "next business
    day" is a forward-looking running minimum over this small table.
    """
    return _calendar(spark.range(1).select(E.as_of_lit(start).cast("date").alias("lo"), E.as_of_lit(end).cast("date").alias("hi")), holidays)


def roll_to_business_day(df: DataFrame, date_col: str, calendar: DataFrame, out: str | None = None) -> DataFrame:
    """SC-2: replace ``date_col`` (or write ``out``) with the first business day on or after it; a date that the calendar
    does not cover is an error."""
    out = out or date_col
    cal = F.broadcast(calendar.withColumnRenamed("day", "__day"))
    j = df.join(cal, F.col(date_col) == F.col("__day"), "left")
    missing = F.raise_error(F.concat(F.lit("no business day known for "), F.col(date_col).cast("string")))
    rolled = F.when(F.col(date_col).isNull(), F.lit(None).cast("date")).otherwise(F.coalesce("next_business_day", missing.cast("date")))
    return j.withColumn(out, rolled).drop("__day", "next_business_day")


def action_type(attempt, days, risk_level):
    """SC-3: action for an attempt given the days overdue at that time and the risk level."""
    a, d, r = E.col(attempt), E.col(days), E.col(risk_level)
    return (
        F.when(a == 1, "friendly_reminder")
        .when(a == 2, "second_notice")
        .when(a == 3, F.when((r == "very_high") | (d > 30), "call_request").otherwise("second_notice"))
        .when(a == 4, F.when(d > 45, "escalate").otherwise("call_request"))
        .when(a >= 5, F.when(d > 60, "escalate").when(a % 2 == 0, "payment_plan").otherwise("call_request"))
        .otherwise("friendly_reminder")
    )


def generate_schedule(
    targets: DataFrame, as_of, holidays: DataFrame | None = None, max_attempts: int | None = None,
    cadences: dict[str, list[int]] | None = None, business_days_only: bool = True, carry: tuple[str, ...] = (),
) -> DataFrame:
    """SC-1: expand each target (invoice_id, customer_id, risk_category, days_overdue) into its dated attempts.

    Unknown risk levels use the medium cadence; ``max_attempts`` keeps the first k attempts. ``as_of`` is the last
    contact date for every invoice. ``carry`` names further columns of the targets to keep behind the schedule's own.
    """
    spark = targets.sparkSession
    cad = cadences or CADENCES
    cadence = cadence_table(spark, cad)
    if max_attempts:
        cadence = cadence.where(F.col("attempt_number") <= max_attempts)
    level = F.when(F.col("risk_category").isin(list(cad)), F.col("risk_category")).otherwise(F.lit("medium"))
    t = targets.select(
        "invoice_id", "customer_id", F.coalesce(F.col("risk_category"), F.lit("medium")).alias("risk_category"),
        F.coalesce(F.col("days_overdue"), F.lit(0)).alias("days_overdue"), *carry,
    ).withColumn("risk_level", level)
    x = t.join(F.broadcast(cadence), "risk_level")
    x = x.withColumn("target_date", F.date_add(E.as_of_lit(as_of).cast("date"), F.col("days_offset")))
    if business_days_only:
        max_off = max(max(v) for v in cad.values())
        cal = business_calendar(spark, as_of, F.date_add(E.as_of_lit(as_of).cast("date"), max_off), holidays)
        x = roll_to_business_day(x, "target_date", cal, out="scheduled_date")
    else:
        x = x.withColumn("scheduled_date", F.col("target_date"))
    est = F.col("days_overdue") + F.col("days_offset")
    return x.select(
        "invoice_id", "customer_id", "attempt_number", "scheduled_date",
        action_type("attempt_number", est, "risk_category").alias("action_type"),
        F.col("days_offset").alias("days_from_last_contact"),
        est.alias("estimated_days_overdue"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("reschedule_reason"),
        F.lit(None).cast("date").alias("completed_date"),
        F.lit(None).cast("string").alias("completion_notes"),
        F.lit(None).cast("string").alias("cancellation_reason"),
        F.lit(None).cast("date").alias("cancelled_date"),
        *carry,
    )


def todays_actions(schedule: DataFrame, as_of) -> DataFrame:
    """SC-4: pending actions scheduled on ``as_of``."""
    return schedule.where((F.col("scheduled_date") == E.as_of_lit(as_of).cast("date")) & (F.col("status") == "pending"))


def this_weeks_actions(schedule: DataFrame, as_of, days: int = 7) -> DataFrame:
    """SC-5: pending actions in [as_of, as_of + 7], earliest first."""
    a = E.as_of_lit(as_of).cast("date")
    return schedule.where(
        (F.col("scheduled_date") >= a) & (F.col("scheduled_date") <= F.date_add(a, days)) & (F.col("status") == "pending")
    ).orderBy("scheduled_date", "invoice_id", "attempt_number")


def last_updates(updates: DataFrame, **values: str) -> DataFrame:
    """One row per (invoice_id, attempt_number): updates are applied in the order of their ``sequence`` column (where there
    is one; then of the values themselves), so the last wins, and a value that it leaves out stays from before.

    ``values`` names the output column of each update column.
    """
    seq = F.col("sequence") if "sequence" in updates.columns else F.lit(0)
    order = F.struct(seq, *values.values())
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(name) for name, c in values.items()]
    return updates.groupBy("invoice_id", "attempt_number").agg(*latest, F.lit(True).alias("__hit"))


def reschedule(schedule: DataFrame, updates: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """SC-6: move (invoice_id, attempt_number) to ``new_date`` rolled to a business day; record ``reason``. Of several
    updates of one attempt the last wins (see ``last_updates``)."""
    span = updates.agg(F.min("new_date").alias("lo"), F.max("new_date").alias("hi"))
    upd = last_updates(updates, __new="new_date", __reason="reason")
    upd = roll_to_business_day(upd, "__new", _calendar(span, holidays)).drop("__hit")
    j = schedule.join(upd, ["invoice_id", "attempt_number"], "left")
    hit = F.col("__new").isNotNull()
    return j.withColumn("scheduled_date", F.when(hit, F.col("__new")).otherwise(F.col("scheduled_date"))).withColumn(
        "reschedule_reason", F.when(hit & F.col("__reason").isNotNull(), F.col("__reason")).otherwise(F.col("reschedule_reason"))
    ).select(*schedule.columns)


def mark_completed(schedule: DataFrame, updates: DataFrame) -> DataFrame:
    """SC-7: set status completed, completed_date and notes for (invoice_id, attempt_number); the last update wins."""
    upd = last_updates(updates, __done="completed_date", __notes="notes")
    j = schedule.join(upd, ["invoice_id", "attempt_number"], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return (
        j.withColumn("status", F.when(hit, F.lit("completed")).otherwise(F.col("status")))
        .withColumn("completed_date", F.when(hit, F.col("__done")).otherwise(F.col("completed_date")))
        .withColumn("completion_notes", F.when(hit & F.col("__notes").isNotNull(), F.col("__notes")).otherwise(F.col("completion_notes")))
        .select(*schedule.columns)
    )


def cancel_future_actions(schedule: DataFrame, paid_ids: DataFrame, as_of, reason: str = "Payment received") -> DataFrame:
    """SC-8: cancel the pending actions of paid invoices."""
    paid = paid_ids.select("invoice_id").distinct().withColumn("__paid", F.lit(True))
    j = schedule.join(paid, "invoice_id", "left")
    hit = F.coalesce(F.col("__paid"), F.lit(False)) & (F.col("status") == "pending")
    return (
        j.withColumn("cancellation_reason", F.when(hit, F.lit(reason)).otherwise(F.col("cancellation_reason")))
        .withColumn("cancelled_date", F.when(hit, E.as_of_lit(as_of).cast("date")).otherwise(F.col("cancelled_date")))
        .withColumn("status", F.when(hit, F.lit("cancelled")).otherwise(F.col("status")))
        .select(*schedule.columns)
    )


def weekly_plan(scored: DataFrame, as_of, schedule: DataFrame | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """SC-9: this week's pending actions with amount, due date and risk; priority = risk x amount."""
    facts = ("invoice_amount", "due_date", "risk_score")
    if schedule is None:  # made here, the schedule carries what the plan needs: nothing is joined back
        targets = scored.withColumn("days_overdue", E.days_overdue("due_date", as_of))
        plan = this_weeks_actions(generate_schedule(targets, as_of, holidays, carry=facts), as_of)
    else:
        inv = scored.select("invoice_id", F.col("customer_id").alias("__cust"), *facts)
        plan = this_weeks_actions(schedule, as_of).join(inv, "invoice_id", "left")
        plan = plan.withColumn("customer_id", F.coalesce("customer_id", "__cust")).drop("__cust")
    return plan.withColumn("priority_score", F.col("risk_score") * F.col("invoice_amount")).orderBy(
        F.asc("scheduled_date"), F.desc("priority_score"), "invoice_id", "attempt_number"
    )


def cadence_summary(scored: DataFrame, cadences: dict[str, list[int]] | None = None) -> DataFrame:
    """SC-10: attempts, cadence text and duration per risk level, with how many open invoices use each cadence."""
    spark = scored.sparkSession
    cad = cadence_table(spark, cadences)
    summary = cad.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt_number", "days_offset"))), lambda s: s["days_offset"].cast("string")), ", ").alias("cadence_days"),
        F.max("days_offset").alias("total_duration_days"),
    )
    known = list((cadences or CADENCES))
    level = F.when(F.col("risk_category").isin(known), F.col("risk_category")).otherwise(F.lit("medium"))
    usage = scored.groupBy(level.alias("risk_level")).agg(F.count(F.lit(1)).alias("open_invoices"))
    return summary.join(usage, "risk_level", "left").select(
        F.concat("risk_level", F.lit("_risk")).alias("risk_level"), "total_attempts", "cadence_days", "total_duration_days",
        F.coalesce(F.col("open_invoices"), F.lit(0)).alias("open_invoices"),
        (F.coalesce(F.col("open_invoices"), F.lit(0)) * F.col("total_attempts")).alias("scheduled_actions"),
    )


def schedule_effectiveness(schedule: DataFrame, payments: DataFrame | None) -> DataFrame:
    """SC-11: totals by status, completion rate, completed actions per type and mean max-attempt of paid invoices.

    The schedule is reduced once to (invoice, action type) counts; the totals, the per-type distribution and the
    per-invoice maximum attempt all derive from that one aggregate (one shuffle of the schedule, reused).
    """
    g = schedule.groupBy("invoice_id", "action_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "completed").alias("c"),
        F.count_if(F.col("status") == "cancelled").alias("x"),
        F.count_if(F.col("status") == "pending").alias("p"),
        F.max("attempt_number").alias("m"),
    )
    tot = g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_actions"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("completed_actions"),
        F.coalesce(F.sum("x"), F.lit(0)).alias("cancelled_actions"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("pending_actions"),
    )
    # One row per action type (a small, fixed vocabulary), so collecting them into one string is bounded.
    per_type = (
        g.groupBy("action_type").agg(F.sum("c").alias("n")).where(F.col("n") > 0)
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat("action_type", F.lit(":"), F.col("n").cast("string")))), ", ").alias("action_type_distribution"))
    )
    out = tot.crossJoin(per_type)
    if payments is not None:
        paid = payments.select("invoice_id").distinct()
        att = g.groupBy("invoice_id").agg(F.max("m").alias("m")).join(paid, "invoice_id", "left_semi")
        out = out.crossJoin(att.agg(E.round_dec(F.avg("m"), 6).alias("avg_attempts_to_payment")))
    return out.select(
        F.col("total_actions").cast("long").alias("total_actions"), F.col("completed_actions").cast("long").alias("completed_actions"),
        F.coalesce(E.round_dec(F.try_divide(F.col("completed_actions"), F.col("total_actions")), 6), F.lit(0.0)).alias("completion_rate"),
        F.col("cancelled_actions").cast("long").alias("cancelled_actions"), F.col("pending_actions").cast("long").alias("pending_actions"),
        "action_type_distribution",
        *(["avg_attempts_to_payment"] if payments is not None else []),
    )
