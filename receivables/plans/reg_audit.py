"""Registered queries: audit log history and success metrics (AU-3..AU-8)."""

from __future__ import annotations

import datetime as dt

from receivables.operators import audit
from receivables.plans.catalog import register
from receivables.plans.sqlfrag import pct, round_dec

V = ("audit_actions", "audit_responses", "audit_outcomes")

# A date range and an action type that really cut rows: the events lie in January 2024.
START, START_SQL = dt.datetime(2024, 1, 8), "TIMESTAMP '2024-01-08 00:00:00'"
END, END_SQL = dt.datetime(2024, 1, 22, 12), "TIMESTAMP '2024-01-22 12:00:00'"
KIND = "second_notice"

# D13 as amended: the records of an action are listed with it, every outcome without a known action in a row of its own.
LISTED = """SELECT a.action_id, a.invoice_id, a.customer_id, a.action_type, a.action_date, a.channel, a.sent_by, a.notes,
       r.response_type, r.response_date, r.payment_promised, o.outcome_type, o.amount_collected, o.days_to_payment,
       a.action_date AS happened
FROM audit_actions a LEFT JOIN audit_responses r USING (action_id) LEFT JOIN audit_outcomes o USING (action_id)
UNION ALL
SELECT NULL, o.invoice_id, (SELECT min(customer_id) FROM audit_actions a WHERE a.invoice_id = o.invoice_id), NULL, NULL, NULL,
       NULL, NULL, NULL, NULL, NULL, o.outcome_type, o.amount_collected, o.days_to_payment, o.outcome_date
FROM audit_outcomes o WHERE NOT EXISTS (SELECT 1 FROM audit_actions a WHERE a.action_id = o.action_id)"""


@register(
    "invoice_history", "AU-3",
    f"""WITH listed AS ({LISTED}),
money AS (SELECT invoice_id, count(*) AS invoice_outcomes,
                 CAST(sum(CAST(amount_collected AS decimal(18,2))) AS double) AS invoice_amount_collected
          FROM audit_outcomes GROUP BY invoice_id)
SELECT l.invoice_id, action_id, action_date, action_type, channel, sent_by, response_type, response_date, payment_promised,
       outcome_type, amount_collected, invoice_outcomes, invoice_amount_collected
FROM listed l LEFT JOIN money ON l.invoice_id = money.invoice_id""",
    views=V,
)
def q_invoice_history(fx):
    return audit.invoice_history(fx.audit_actions, fx.audit_responses, fx.audit_outcomes)


@register(
    "customer_action_history", "AU-4",
    f"""WITH listed AS ({LISTED})
SELECT customer_id, invoice_id, action_id, action_date, action_type, channel, response_type, outcome_type FROM listed""",
    views=V,
)
def q_customer_action_history(fx):
    return audit.customer_history(fx.audit_actions, fx.audit_responses, fx.audit_outcomes)


@register(
    "audit_export", "AU-7",
    f"""WITH listed AS ({LISTED})
SELECT action_id, invoice_id, customer_id, action_type, action_date, channel, sent_by, response_type, response_date,
       payment_promised, outcome_type, amount_collected, days_to_payment, notes
FROM listed WHERE happened >= {START_SQL} AND happened <= {END_SQL}""",
    views=V,
)
def q_audit_export(fx):
    return audit.audit_export(fx.audit_actions, fx.audit_responses, fx.audit_outcomes, start=START, end=END)


# Written from the definitions of AU-5 and AU-6: the actions in range, those of them with a paid outcome, those with a
# response; means and sums run over every pair of one of an action's outcomes with one of its responses (or none).
PAIRS = """pairs AS (
  SELECT o.action_id, o.days_to_payment, CAST(o.amount_collected AS decimal(18,2)) AS money
  FROM audit_outcomes o LEFT JOIN audit_responses r ON r.action_id = o.action_id)"""


@register(
    "success_metrics", "AU-5",
    f"""WITH picked AS (
  SELECT action_id FROM audit_actions
  WHERE action_type = '{KIND}' AND action_date BETWEEN {START_SQL} AND {END_SQL}),
{PAIRS},
n AS (SELECT (SELECT count(*) FROM picked) AS everyone,
             (SELECT count(*) FROM picked WHERE action_id IN (SELECT action_id FROM audit_outcomes WHERE outcome_type = 'paid')) AS winners,
             (SELECT count(*) FROM picked WHERE action_id IN (SELECT action_id FROM audit_responses)) AS answered),
m AS (SELECT avg(days_to_payment) AS days, sum(money) AS money FROM pairs SEMI JOIN picked ON pairs.action_id = picked.action_id)
SELECT everyone AS total_actions, winners AS successful_actions,
       coalesce({round_dec('CAST(winners AS double) / NULLIF(everyone, 0)', 6)}, 0.0) AS success_rate,
       coalesce({round_dec('CAST(answered AS double) / NULLIF(everyone, 0)', 6)}, 0.0) AS response_rate,
       coalesce({round_dec('days', 6)}, 0.0) AS avg_days_to_payment, CAST(coalesce(money, 0) AS double) AS total_amount_collected
FROM n, m""",
    views=V,
)
def q_success_metrics(fx):
    return audit.success_metrics(fx.audit_actions, fx.audit_responses, fx.audit_outcomes, start=START, end=END, action_type=KIND)


@register(
    "action_effectiveness", "AU-6",
    f"""WITH {PAIRS},
sent AS (SELECT action_type, count(*) AS total_sent FROM audit_actions GROUP BY action_type),
answers AS (SELECT action_type, count(*) AS n FROM audit_responses NATURAL JOIN (SELECT action_id, action_type FROM audit_actions) GROUP BY action_type),
paid AS (SELECT action_type, count(*) AS n FROM audit_outcomes NATURAL JOIN (SELECT action_id, action_type FROM audit_actions)
         WHERE outcome_type = 'paid' GROUP BY action_type),
m AS (SELECT action_type, avg(days_to_payment) AS days, sum(money) AS money
      FROM pairs NATURAL JOIN (SELECT action_id, action_type FROM audit_actions) GROUP BY action_type),
g AS (SELECT sent.action_type, total_sent, coalesce(answers.n, 0) AS responses_received, coalesce(paid.n, 0) AS payments_received, days, money
      FROM sent LEFT JOIN answers USING (action_type) LEFT JOIN paid USING (action_type) LEFT JOIN m USING (action_type))
SELECT action_type, total_sent, responses_received, payments_received, {round_dec('days', 6)} AS avg_days_to_payment,
       CAST(money AS double) AS total_collected, {pct('responses_received', 'total_sent')} AS response_rate,
       {pct('payments_received', 'total_sent')} AS payment_rate
FROM g""",
    views=V,
)
def q_action_effectiveness(fx):
    return audit.action_effectiveness(fx.audit_actions, fx.audit_responses, fx.audit_outcomes)


@register(
    "daily_success_metrics", "AU-8",
    f"""SELECT CAST(a.action_date AS DATE) AS metric_date, a.action_type, count(*) AS total_actions,
       count(*) FILTER (WHERE coalesce(o.n_paid, 0) > 0) AS successful_actions,
       CAST(coalesce(sum(o.sa), 0) AS double) AS total_amount_collected,
       {round_dec('CAST(sum(o.sd) AS double) / NULLIF(sum(o.nd), 0)', 6)} AS avg_days_to_payment,
       {pct("count(*) FILTER (WHERE coalesce(o.n_paid, 0) > 0)", 'count(*)')} AS success_rate
FROM audit_actions a LEFT JOIN (
  SELECT action_id, count(*) FILTER (WHERE outcome_type = 'paid') AS n_paid, sum(CAST(amount_collected AS decimal(18,2))) AS sa,
         sum(days_to_payment) AS sd, count(days_to_payment) AS nd
  FROM audit_outcomes GROUP BY action_id) o ON a.action_id = o.action_id
GROUP BY 1, 2""",
    views=("audit_actions", "audit_outcomes"),
)
def q_daily_success_metrics(fx):
    return audit.daily_success_metrics(fx.audit_actions, fx.audit_outcomes)
