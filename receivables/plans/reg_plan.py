"""Registered queries: rule risk scores, recommendations and scheduling (RS-1, RC-*, SC-*)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import model, recommend, schedule, scoring
from receivables.plans.catalog import AS_OF, AS_OF_SQL, register
from receivables.plans.sqlfrag import overdue, risk_cat, round_dec
from receivables.session import ensure_checkpoint_dir
from receivables.sources import tables
from receivables.streaming import cancellations, followups

A = AS_OF_SQL
# Fixed fixture parameters (FIXTURES.md §3).
HOLIDAYS = [dt.date(2001, 7, 4), dt.date(2001, 7, 5)]
TODAY = dt.date(2001, 7, 2)
NEW_DATE = dt.date(2001, 7, 4)

SCORED_CTE = f"""scored AS (
SELECT invoice_id, customer_id, issue_date, due_date, invoice_amount, currency, status, risk_score,
       {risk_cat('risk_score')} AS risk_category
FROM (SELECT i.*, CAST(round_even(
        least(100.0, greatest(0.0, {overdue('i.due_date', A)} / 90 * 100)) * 0.40
      + CASE WHEN p.amount_p95 > 0 THEN least(100.0, greatest(0.0, i.invoice_amount / p.amount_p95 * 100)) ELSE 0.0 END * 0.20
      + least(100.0, greatest(0.0, coalesce(pc.payment_terms_days, 30) / 60 * 100)) * 0.20
      + CASE WHEN coalesce(pc.credit_limit, 999999.0) != 0
             THEN least(100.0, greatest(0.0, pc.total_outstanding / coalesce(pc.credit_limit, 999999.0) * 100))
             WHEN pc.total_outstanding > 0 THEN 100.0 ELSE 0.0 END * 0.20, 0) AS int) AS risk_score
      FROM invoices i
      LEFT JOIN (SELECT t.customer_id, t.total_outstanding, c.payment_terms_days, c.credit_limit
                 FROM (SELECT customer_id, CAST(sum(CAST(invoice_amount AS decimal(18,2))) AS double) AS total_outstanding
                       FROM invoices GROUP BY customer_id) t
                 LEFT JOIN customers c ON t.customer_id = c.customer_id) pc ON i.customer_id = pc.customer_id,
      (SELECT quantile_cont(invoice_amount, 0.95) AS amount_p95 FROM invoices) p) x
WHERE status = 'open')"""


def scored(fx):
    return scoring.rule_risk_scores(fx.invoices, fx.customers, AS_OF, sort=False)


@register("risk_scores", "RS-1 / FN-4 / ML-6 (rules)", f"WITH {SCORED_CTE} SELECT * FROM scored", views=("invoices", "customers"))
def q_risk_scores(fx):
    return scoring.rule_risk_scores(fx.invoices, fx.customers, AS_OF)


RECS_CTE = f"""ac AS (SELECT invoice_id, count(*) AS prior_actions FROM csv_actions GROUP BY invoice_id),
r AS (SELECT s.*, {overdue('s.due_date', A)} AS days_overdue, c.name,
             CAST(coalesce(ac.prior_actions, 0) AS int) AS prior_actions, s.invoice_amount >= 10000 AS is_high_value
      FROM scored s LEFT JOIN customers c ON s.customer_id = c.customer_id LEFT JOIN ac ON s.invoice_id = ac.invoice_id),
r2 AS (SELECT *, CAST(trunc(least(100.0, days_overdue / 90 * 100) * 0.4 + CAST(coalesce(risk_score, 50) AS double) * 0.3
                     + least(100.0, invoice_amount / 50000 * 100) * 0.2 + least(100.0, prior_actions / 5 * 100) * 0.1) AS int)
             AS action_priority FROM r),
recs AS (
SELECT *,
  CASE WHEN prior_actions >= 5 THEN 'escalate'
       WHEN days_overdue <= 0 AND coalesce(risk_score, 50) >= 70 THEN 'friendly_reminder'
       WHEN days_overdue > 0 AND days_overdue <= 3 THEN CASE WHEN prior_actions = 0 THEN 'friendly_reminder' ELSE 'second_reminder' END
       WHEN days_overdue >= 4 AND days_overdue <= 10 THEN CASE WHEN prior_actions = 0 THEN 'reminder_with_inquiry' ELSE 'call' END
       WHEN days_overdue >= 11 AND days_overdue <= 20 THEN CASE WHEN is_high_value THEN 'call' ELSE 'firm_reminder' END
       WHEN days_overdue >= 21 AND days_overdue <= 45 THEN CASE WHEN prior_actions < 2 THEN 'payment_plan_offer' ELSE 'pause_service_warning' END
       ELSE CASE WHEN is_high_value THEN 'escalate' ELSE 'final_notice' END END AS recommended_action,
  CASE WHEN action_priority >= 75 THEN 'critical' WHEN action_priority >= 50 THEN 'high'
       WHEN action_priority >= 25 THEN 'medium' ELSE 'low' END AS urgency,
  CASE WHEN is_high_value AND days_overdue < 15 THEN 'friendly' WHEN days_overdue <= 7 AND prior_actions = 0 THEN 'friendly'
       WHEN prior_actions >= 2 OR days_overdue >= 30 THEN 'firm' ELSE 'neutral' END AS message_tone
FROM r2)"""


def recs(fx):
    named = scoring.rule_risk_scores(fx.invoices, fx.customers, AS_OF, sort=False, carry=("name",))
    return recommend.recommend_actions(named, fx.customers, fx.csv_actions, AS_OF)


@register(
    "recommendations", "RC-1..RC-6",
    f"WITH {SCORED_CTE}, {RECS_CTE} SELECT * FROM recs",
    views=("invoices", "customers", "csv_actions"),
)
def q_recommendations(fx):
    return recs(fx)


@register(
    "top_recommendations", "RC-7 (plan command)",
    f"WITH {SCORED_CTE}, {RECS_CTE} SELECT * FROM recs WHERE action_priority >= 0 ORDER BY action_priority DESC, invoice_id LIMIT 30",
    views=("invoices", "customers", "csv_actions"),
)
def q_top_recommendations(fx):
    return recommend.top_recommendations(recs(fx), 30, 0)


NEXT_CTE = f"""h AS (SELECT invoice_id, count(*) AS n_prev, bool_or(action_type = 'friendly_reminder') AS fr,
             bool_or(action_type = 'second_notice') AS sn, bool_or(action_type = 'call_request') AS cr
      FROM audit_actions GROUP BY invoice_id),
x AS (SELECT s.invoice_id, s.customer_id, {overdue('s.due_date', A)} AS d, s.risk_score AS r,
             coalesce(h.n_prev, 0) AS n, coalesce(h.fr, false) AS fr, coalesce(h.sn, false) AS sn, coalesce(h.cr, false) AS cr
      FROM scored s LEFT JOIN h ON s.invoice_id = h.invoice_id),
nc AS (
SELECT invoice_id, customer_id, d AS days_overdue, r AS risk_score, CAST(n AS bigint) AS previous_contacts,
  CASE WHEN d <= 7 AND r < 50 THEN 'friendly_reminder'
       WHEN d <= 15 AND fr THEN 'second_notice'
       WHEN d <= 30 AND sn THEN CASE WHEN r >= 70 THEN 'call_request' ELSE 'payment_plan' END
       WHEN d <= 60 AND cr THEN 'payment_plan'
       WHEN d > 60 OR r >= 90 THEN 'escalate'
       WHEN n = 0 THEN 'friendly_reminder' WHEN n = 1 THEN 'second_notice' WHEN n = 2 THEN 'call_request'
       ELSE 'escalate' END AS next_action
FROM x)"""


@register(
    "next_contact", "RC-8",
    f"WITH {SCORED_CTE}, {NEXT_CTE} SELECT * FROM nc",
    views=("invoices", "customers", "audit_actions"),
)
def q_next_contact(fx):
    return recommend.next_contact(scored(fx), fx.audit_actions, AS_OF)


_CAD_VALUES = ", ".join(
    f"('{lvl}', {i + 1}, {d})" for lvl, days in schedule.CADENCES.items() for i, d in enumerate(days)
)
SCHED_CTE = f"""cad AS (SELECT * FROM (VALUES {_CAD_VALUES}) t(risk_level, attempt_number, days_offset)),
hol AS (SELECT * FROM (VALUES (DATE '2001-07-04'), (DATE '2001-07-05')) h(holiday)),
cal AS (SELECT day, min(CASE WHEN isodow(day) <= 5 AND day NOT IN (SELECT holiday FROM hol) THEN day END)
                      OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_business_day
        FROM (SELECT CAST(unnest(generate_series(CAST({A} AS TIMESTAMP), CAST({A} + 44 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day) d),
tg AS (SELECT invoice_id, customer_id, risk_category, {overdue('due_date', A)} AS days_overdue,
              CASE WHEN risk_category IN ('low', 'medium', 'high', 'very_high') THEN risk_category ELSE 'medium' END AS lvl
       FROM scored),
sched AS (
  SELECT tg.invoice_id, tg.customer_id, cad.attempt_number, cal.next_business_day AS scheduled_date,
         CASE WHEN cad.attempt_number = 1 THEN 'friendly_reminder'
              WHEN cad.attempt_number = 2 THEN 'second_notice'
              WHEN cad.attempt_number = 3 THEN CASE WHEN tg.risk_category = 'very_high' OR days_overdue + days_offset > 30 THEN 'call_request' ELSE 'second_notice' END
              WHEN cad.attempt_number = 4 THEN CASE WHEN days_overdue + days_offset > 45 THEN 'escalate' ELSE 'call_request' END
              WHEN cad.attempt_number >= 5 THEN CASE WHEN days_overdue + days_offset > 60 THEN 'escalate'
                                                     WHEN cad.attempt_number % 2 = 0 THEN 'payment_plan' ELSE 'call_request' END
              ELSE 'friendly_reminder' END AS action_type,
         cad.days_offset AS days_from_last_contact, days_overdue + days_offset AS estimated_days_overdue,
         'pending' AS status, CAST(NULL AS VARCHAR) AS reschedule_reason, CAST(NULL AS DATE) AS completed_date,
         CAST(NULL AS VARCHAR) AS completion_notes, CAST(NULL AS VARCHAR) AS cancellation_reason, CAST(NULL AS DATE) AS cancelled_date
  FROM tg JOIN cad ON tg.lvl = cad.risk_level JOIN cal ON cal.day = {A} + cad.days_offset)"""

SCHED_VIEWS = ("invoices", "customers")


def holidays(fx):
    return schedule.holiday_table(fx.spark, HOLIDAYS)


def sched(fx):
    targets = scored(fx).withColumn("days_overdue", E.days_overdue("due_date", AS_OF))
    return schedule.generate_schedule(targets, AS_OF, holidays(fx))


@register("schedule", "SC-1 / SC-2 / SC-3", f"WITH {SCORED_CTE}, {SCHED_CTE} SELECT * FROM sched", views=SCHED_VIEWS)
def q_schedule(fx):
    return sched(fx)


@register(
    "schedule_today", "SC-4",
    f"WITH {SCORED_CTE}, {SCHED_CTE} SELECT * FROM sched WHERE scheduled_date = DATE '2001-07-02' AND status = 'pending'",
    views=SCHED_VIEWS,
)
def q_schedule_today(fx):
    return schedule.todays_actions(sched(fx), TODAY)


@register(
    "schedule_week", "SC-5",
    f"""WITH {SCORED_CTE}, {SCHED_CTE} SELECT * FROM sched
WHERE scheduled_date >= {A} AND scheduled_date <= {A} + 7 AND status = 'pending'""",
    views=SCHED_VIEWS,
)
def q_schedule_week(fx):
    return schedule.this_weeks_actions(sched(fx), AS_OF)


def updates(fx, kind: str):
    # Fixture rule: the customers of open invoices that fell due in June answered, so the first follow-up of those
    # invoices is moved (rescheduled) or done (completed).
    ids = fx.invoices.where(
        (F.col("status") == "open") & F.col("due_date").between(dt.date(2001, 6, 1), dt.date(2001, 6, 30))
    ).select("invoice_id", F.lit(1).alias("attempt_number"))
    # Every attempt is updated twice; the later update (by sequence) is the one that counts.
    twice = ids.crossJoin(fx.spark.createDataFrame([(2,), (1,)], "sequence int"))
    last = F.col("sequence") == 2
    if kind == "reschedule":
        return twice.select(
            "invoice_id", "attempt_number", "sequence", F.when(last, F.lit(NEW_DATE)).otherwise(F.lit(dt.date(2001, 8, 1))).alias("new_date"),
            F.when(last, F.lit("customer requested")).otherwise(F.lit("zz earlier call")).alias("reason"),
        )
    return twice.select(
        "invoice_id", "attempt_number", "sequence", F.when(last, F.lit(AS_OF)).otherwise(F.lit(dt.date(2001, 7, 30))).alias("completed_date"),
        F.when(last, F.lit("left voicemail")).otherwise(F.lit("zz no answer")).alias("notes"),
    )


UPD_CTE = ("upd AS (SELECT invoice_id, 1 AS attempt_number FROM invoices "
           "WHERE status = 'open' AND due_date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30')")
_COLS = (
    "invoice_id, customer_id, attempt_number, scheduled_date, action_type, days_from_last_contact, "
    "estimated_days_overdue, status, reschedule_reason, completed_date, completion_notes, cancellation_reason, cancelled_date"
)


@register(
    "schedule_rescheduled", "SC-6",
    f"""WITH {SCORED_CTE}, {SCHED_CTE}, {UPD_CTE},
nd AS (SELECT min(day) AS d FROM cal WHERE day >= DATE '2001-07-04' AND isodow(day) <= 5 AND day NOT IN (SELECT holiday FROM hol))
SELECT s.invoice_id, s.customer_id, s.attempt_number,
       CASE WHEN u.invoice_id IS NOT NULL THEN nd.d ELSE s.scheduled_date END AS scheduled_date,
       action_type, days_from_last_contact, estimated_days_overdue, status,
       CASE WHEN u.invoice_id IS NOT NULL THEN 'customer requested' ELSE reschedule_reason END AS reschedule_reason,
       completed_date, completion_notes, cancellation_reason, cancelled_date
FROM sched s LEFT JOIN upd u ON s.invoice_id = u.invoice_id AND s.attempt_number = u.attempt_number, nd""",
    views=SCHED_VIEWS,
)
def q_schedule_rescheduled(fx):
    return schedule.reschedule(sched(fx), updates(fx, "reschedule"), holidays(fx))


COMPLETED_CTE = f"""comp AS (
SELECT s.invoice_id, s.customer_id, s.attempt_number, scheduled_date, action_type, days_from_last_contact,
       estimated_days_overdue,
       CASE WHEN u.invoice_id IS NOT NULL THEN 'completed' ELSE status END AS status, reschedule_reason,
       CASE WHEN u.invoice_id IS NOT NULL THEN {A} ELSE completed_date END AS completed_date,
       CASE WHEN u.invoice_id IS NOT NULL THEN 'left voicemail' ELSE completion_notes END AS completion_notes,
       cancellation_reason, cancelled_date
FROM sched s LEFT JOIN upd u ON s.invoice_id = u.invoice_id AND s.attempt_number = u.attempt_number)"""


@register(
    "schedule_completed", "SC-7",
    f"WITH {SCORED_CTE}, {SCHED_CTE}, {UPD_CTE}, {COMPLETED_CTE} SELECT * FROM comp",
    views=SCHED_VIEWS,
)
def q_schedule_completed(fx):
    return schedule.mark_completed(sched(fx), updates(fx, "complete"))


def _cancel_sql(src: str) -> str:
    return f"""canc AS (
SELECT s.invoice_id, customer_id, attempt_number, scheduled_date, action_type, days_from_last_contact, estimated_days_overdue,
       CASE WHEN p.invoice_id IS NOT NULL AND s.status = 'pending' THEN 'cancelled' ELSE s.status END AS status,
       reschedule_reason, completed_date, completion_notes,
       CASE WHEN p.invoice_id IS NOT NULL AND s.status = 'pending' THEN 'Payment received' ELSE cancellation_reason END AS cancellation_reason,
       CASE WHEN p.invoice_id IS NOT NULL AND s.status = 'pending' THEN {A} ELSE cancelled_date END AS cancelled_date
FROM {src} s LEFT JOIN (SELECT DISTINCT invoice_id FROM payments) p ON s.invoice_id = p.invoice_id)"""


@register(
    "schedule_cancelled", "SC-8",
    f"WITH {SCORED_CTE}, {SCHED_CTE}, {_cancel_sql('sched')} SELECT * FROM canc",
    views=SCHED_VIEWS + ("payments",),
)
def q_schedule_cancelled(fx):
    return schedule.cancel_future_actions(sched(fx), fx.payments, AS_OF)


@register(
    "schedule_stream", "SC-1 / SC-2 / SC-6 / SC-7 / SC-8",
    f"""WITH {SCORED_CTE}, {SCHED_CTE}, {UPD_CTE},
nd AS (SELECT min(day) AS d FROM cal WHERE day >= DATE '2001-07-04' AND isodow(day) <= 5 AND day NOT IN (SELECT holiday FROM hol)),
pay AS (SELECT invoice_id, min(payment_date) AS paid FROM payments GROUP BY invoice_id)
SELECT s.invoice_id, s.customer_id, s.attempt_number,
       CASE WHEN u.invoice_id IS NOT NULL THEN nd.d ELSE s.scheduled_date END AS scheduled_date,
       action_type, days_from_last_contact, estimated_days_overdue,
       CASE WHEN u.invoice_id IS NOT NULL THEN 'completed' WHEN paid IS NOT NULL THEN 'cancelled' ELSE status END AS status,
       CASE WHEN u.invoice_id IS NOT NULL THEN 'customer requested' END AS reschedule_reason,
       CASE WHEN u.invoice_id IS NOT NULL THEN {A} END AS completed_date,
       CASE WHEN u.invoice_id IS NOT NULL THEN 'left voicemail' END AS completion_notes,
       CASE WHEN u.invoice_id IS NULL AND paid IS NOT NULL THEN 'Payment received' END AS cancellation_reason,
       CASE WHEN u.invoice_id IS NULL THEN paid END AS cancelled_date
FROM sched s LEFT JOIN upd u ON s.invoice_id = u.invoice_id AND s.attempt_number = u.attempt_number
LEFT JOIN pay ON s.invoice_id = pay.invoice_id, nd""",
    views=SCHED_VIEWS + ("payments",),
)
def q_schedule_stream(fx):
    """Targets, updates and payments fed to the stream in two halves, each half's targets after its updates, with a restart between."""
    folder = f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/followups-{uuid.uuid4().hex}"
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    targets = scored(fx).withColumn("days_overdue", E.days_overdue("due_date", AS_OF)).withColumn("last_contact", F.lit(AS_OF))
    moves = updates(fx, "reschedule").withColumn("kind", F.lit(followups.MOVED))
    given = moves.unionByName(updates(fx, "complete").withColumn("kind", F.lit(followups.DONE)), allowMissingColumns=True)
    given = given.withColumn("sequence", F.col("sequence").cast("long")).withColumn("at", F.lit(dt.datetime.combine(AS_OF, dt.time())).cast("timestamp_ntz"))
    half = F.pmod(F.xxhash64("invoice_id"), F.lit(2))
    for n in (0, 1):
        tables.save(given.where(half == 1 - n).select(names(followups.UPDATE_EVENTS)), f"{folder}/updates", mode="append")
        tables.save(fx.payments.where(half == 1 - n).select(names(cancellations.PAYMENT_EVENT_SCHEMA)), f"{folder}/payments", mode="append")
        tables.save(targets.where(half == n).select(names(followups.TARGET_EVENTS)), f"{folder}/targets", mode="append")
        # The fixtures' payments go back some years: none is late.
        places = (f"{folder}/{x}" for x in ("targets", "updates", "payments", "changes"))
        followups.start(fx.spark, *places, holidays=holidays(fx), late_days=36_500).awaitTermination()
    return followups.current(fx.spark.read.schema(followups.CHANGES).parquet(f"{folder}/changes"))


@register(
    "weekly_plan", "SC-9",
    f"""WITH {SCORED_CTE}, {SCHED_CTE}
SELECT w.invoice_id, coalesce(w.customer_id, s.customer_id) AS customer_id, w.attempt_number, w.scheduled_date,
       w.action_type, w.days_from_last_contact, w.estimated_days_overdue, w.status, w.reschedule_reason,
       w.completed_date, w.completion_notes, w.cancellation_reason, w.cancelled_date,
       s.invoice_amount, s.due_date, s.risk_score, s.risk_score * s.invoice_amount AS priority_score
FROM (SELECT * FROM sched WHERE scheduled_date >= {A} AND scheduled_date <= {A} + 7 AND status = 'pending') w
LEFT JOIN scored s ON w.invoice_id = s.invoice_id""",
    views=SCHED_VIEWS,
)
def q_weekly_plan(fx):
    return schedule.weekly_plan(scored(fx), AS_OF, holidays=holidays(fx))


@register(
    "cadence_summary", "SC-10",
    f"""WITH {SCORED_CTE}, {SCHED_CTE},
cs AS (SELECT risk_level, count(*) AS total_attempts, string_agg(CAST(days_offset AS VARCHAR), ', ' ORDER BY attempt_number) AS cadence_days,
              max(days_offset) AS total_duration_days FROM cad GROUP BY risk_level),
u AS (SELECT lvl, count(*) AS open_invoices FROM tg GROUP BY lvl)
SELECT cs.risk_level || '_risk' AS risk_level, total_attempts, cadence_days, total_duration_days,
       coalesce(open_invoices, 0) AS open_invoices, coalesce(open_invoices, 0) * total_attempts AS scheduled_actions
FROM cs LEFT JOIN u ON cs.risk_level = u.lvl""",
    views=SCHED_VIEWS,
)
def q_cadence_summary(fx):
    return schedule.cadence_summary(scored(fx))


@register(
    "schedule_effectiveness", "SC-11",
    f"""WITH {SCORED_CTE}, {SCHED_CTE}, {UPD_CTE}, {COMPLETED_CTE}, {_cancel_sql('comp')},
t AS (SELECT count(*) AS total_actions, count(*) FILTER (WHERE status = 'completed') AS completed_actions,
             count(*) FILTER (WHERE status = 'cancelled') AS cancelled_actions,
             count(*) FILTER (WHERE status = 'pending') AS pending_actions FROM canc),
pt AS (SELECT string_agg(action_type || ':' || CAST(n AS VARCHAR), ', ' ORDER BY action_type || ':' || CAST(n AS VARCHAR)) AS action_type_distribution
       FROM (SELECT action_type, count(*) AS n FROM canc WHERE status = 'completed' GROUP BY action_type) q),
att AS (SELECT {round_dec('avg(m)', 6)} AS avg_attempts_to_payment FROM (
          SELECT invoice_id, max(attempt_number) AS m FROM canc WHERE invoice_id IN (SELECT invoice_id FROM payments) GROUP BY invoice_id) q)
SELECT total_actions, completed_actions,
       coalesce({round_dec('CAST(completed_actions AS double) / NULLIF(total_actions, 0)', 6)}, 0.0) AS completion_rate,
       cancelled_actions, pending_actions, action_type_distribution, avg_attempts_to_payment
FROM t, pt, att""",
    views=SCHED_VIEWS + ("payments",),
)
def q_schedule_effectiveness(fx):
    s = schedule.cancel_future_actions(schedule.mark_completed(sched(fx), updates(fx, "complete")), fx.payments, AS_OF)
    return schedule.schedule_effectiveness(s, fx.payments)


# ML-7 over a fixed probability (the rule score / 100): due date plus int(p x 45) days.
@register(
    "predicted_payment_rules", "ML-7",
    f"""WITH {SCORED_CTE}
SELECT invoice_id, due_date, risk_score / 100.0 AS p_late, due_date + CAST(trunc(risk_score / 100.0 * 45) AS INTEGER) AS predicted_payment_date
FROM scored""",
    views=SCHED_VIEWS,
)
def q_predicted_payment_rules(fx):
    rows = scored(fx).withColumn("p_late", F.col("risk_score") / F.lit(100.0))
    return model.predict_payment_date(rows).select("invoice_id", "due_date", "p_late", "predicted_payment_date")
