"""Registered queries: outreach message tables (OU-1..OU-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from receivables.operators import outreach, recommend
from receivables.operators import outreach_templates as T
from receivables.plans.catalog import AS_OF, AS_OF_SQL, register
from receivables.plans.reg_plan import NEXT_CTE, RECS_CTE, SCORED_CTE, recs, scored
from receivables.plans.sqlfrag import overdue

A = AS_OF_SQL
TOP_N = 100


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, values: list[tuple[str, str]]) -> str:
    out = template
    for token, value in values:
        out = f"replace({out}, {q(token)}, {value})"
    return out


_TT = ", ".join(f"({q(k)}, {q(s)}, {q(b)}, {q(T.SMS_TEMPLATES[k])})" for k, (s, b) in T.EMAIL_TEMPLATES.items())
_KEYS = ", ".join(q(k) for k in T.EMAIL_TEMPLATES)
_VALUES = [
    ("{payment_instructions}", q(outreach.payment_instructions())),
    ("{invoice_id}", "invoice_id"),
    ("{amount}", "format('{:,.2f}', invoice_amount)"),
    ("{amount0}", "format('{:,.0f}', invoice_amount)"),
    ("{installment}", "format('{:,.2f}', invoice_amount / 3)"),
    ("{due_date}", "strftime(due_date, '%B %d, %Y')"),
    ("{days_overdue}", "CAST(d AS VARCHAR)"),
    ("{company_name}", q(T.COMPANY_NAME)),
    ("{company_phone}", q(T.COMPANY_PHONE)),
    ("{company_email}", q(T.COMPANY_EMAIL)),
    ("{customer_name}", "coalesce(customer_name, customer_id)"),
]


@register(
    "outreach_messages", "OU-1 / OU-2 / OU-3 / OU-4 / OU-5",
    f"""WITH {SCORED_CTE}, {NEXT_CTE},
tg AS (SELECT s.invoice_id, s.customer_id, s.invoice_amount, s.due_date, s.risk_score, nc.next_action AS action_type
       FROM (SELECT * FROM scored ORDER BY risk_score DESC, invoice_id LIMIT {TOP_N}) s LEFT JOIN nc ON s.invoice_id = nc.invoice_id),
tt AS (SELECT * FROM (VALUES {_TT}) t(template_key, subject_t, body_t, sms_t)),
j AS (SELECT tg.*, c.name AS customer_name, c.email AS customer_email, tt.subject_t, tt.body_t, tt.sms_t,
             {overdue('tg.due_date', A)} AS d
      FROM tg JOIN customers c ON tg.customer_id = c.customer_id
      JOIN tt ON tt.template_key = CASE WHEN tg.action_type IN ({_KEYS}) THEN tg.action_type ELSE 'friendly_reminder' END)
SELECT invoice_id, customer_id, customer_name, customer_email, invoice_amount, d AS days_overdue, risk_score, action_type,
       {render_sql('subject_t', _VALUES)} AS email_subject,
       {render_sql('body_t', _VALUES)} AS email_body,
       {render_sql('sms_t', _VALUES)} AS sms_text,
       CAST(length({render_sql('sms_t', _VALUES)}) AS int) AS sms_length
FROM j""",
    views=("invoices", "customers", "audit_actions"),
)
def q_outreach_messages(fx):
    # The contact history is only needed for the selected targets: rank first, then look up their contacts.
    top = outreach.select_targets(scored(fx), TOP_N)
    targets = recommend.next_contact(top, fx.audit_actions, AS_OF, keep_columns=True).drop("days_overdue")
    return outreach.generate_messages(targets, fx.customers, AS_OF, action_type=F.col("next_action"))


_TONES = sorted({tone for _, tone in T.TONE_TEMPLATES})
_TONE_ROWS = ", ".join(
    f"({q(t)}, {q(T.TONE_TEMPLATES[('email', t)]) if ('email', t) in T.TONE_TEMPLATES else 'NULL'}, "
    f"{q(T.TONE_TEMPLATES[('sms', t)]) if ('sms', t) in T.TONE_TEMPLATES else 'CAST(NULL AS VARCHAR)'})"
    for t in _TONES
)
_TONE_VALUES = [
    ("{{ invoice_id }}", "invoice_id"),
    ("{{ invoice_amount }}", "CAST(invoice_amount AS VARCHAR)"),
    ("{{ due_date }}", "CAST(due_date AS VARCHAR)"),
    (T.FRIENDLY_DAYS_LABEL, "CASE WHEN days_overdue > 0 THEN 'overdue' ELSE 'until due' END"),
    (T.FRIENDLY_DAYS_VALUE, f"CAST(CASE WHEN days_overdue > 0 THEN days_overdue ELSE date_diff('day', {A}, due_date) END AS VARCHAR)"),
    ("{{ days_overdue }}", "CAST(days_overdue AS VARCHAR)"),
    ("{{ prior_reminders }}", "CAST(prior_actions AS VARCHAR)"),
    ("{{ customer_name }}", "coalesce(name, customer_id)"),
]


@register(
    "tone_messages", "OU-6",
    f"""WITH {SCORED_CTE}, {RECS_CTE},
tt AS (SELECT * FROM (VALUES {_TONE_ROWS}) t(tone, email_t, sms_t))
SELECT invoice_id, customer_id, message_tone, {render_sql('email_t', _TONE_VALUES)} AS email_text,
       {render_sql('sms_t', _TONE_VALUES)} AS sms_text
FROM recs LEFT JOIN tt ON recs.message_tone = tt.tone""",
    views=("invoices", "customers", "csv_actions"),
)
def q_tone_messages(fx):
    return outreach.tone_messages(recs(fx), AS_OF)
