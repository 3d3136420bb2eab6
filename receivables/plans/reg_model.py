"""Registered queries: features, history and label (FE-*, exact oracles) and the MLlib model (ML-*, rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import features, model
from receivables.plans.catalog import AS_OF, AS_OF_SQL, register
from receivables.plans.sqlfrag import days_late, pct, round_dec
from receivables.session import ensure_checkpoint_dir

A = AS_OF_SQL
FV = ("invoices", "customers", "payments")

HIST_SQL = f"""SELECT customer_id, count(invoice_id) AS customer_invoice_count, coalesce(avg(dl), 0.0) AS customer_avg_days_late,
       {pct('count(*) FILTER (WHERE dl > 0)', 'count(invoice_id)')} AS customer_late_rate,
       CAST(sum(CAST(pay_amount AS decimal(18,2))) AS double) / NULLIF(count(pay_amount), 0) AS customer_avg_payment_amount
FROM (SELECT i.invoice_id, i.customer_id, p.amount AS pay_amount,
             CASE WHEN p.payment_date IS NULL THEN 0 ELSE {days_late('p.payment_date', 'i.due_date')} END AS dl
      FROM (SELECT * FROM invoices WHERE issue_date < {A} AND customer_id IS NOT NULL) i LEFT JOIN payments p ON i.invoice_id = p.invoice_id
      WHERE p.payment_date IS NULL OR p.payment_date < {A}) m
GROUP BY customer_id"""


@register("customer_history", "FE-2", HIST_SQL, views=("invoices", "payments"))
def q_customer_history(fx):
    return features.customer_history(fx.invoices, fx.payments, AS_OF)


@register(
    "late_target", "FE-3",
    f"""SELECT i.invoice_id, i.customer_id, i.due_date, p.payment_date,
       CAST(CASE WHEN p.payment_date IS NULL THEN 0 ELSE {days_late('p.payment_date', 'i.due_date')} END AS int) AS days_late,
       CAST(coalesce(CASE WHEN p.payment_date IS NULL THEN 0 ELSE {days_late('p.payment_date', 'i.due_date')} END > 7, false) AS int) AS is_late
FROM invoices i LEFT JOIN payments p ON i.invoice_id = p.invoice_id""",
    views=("invoices", "payments"),
)
def q_late_target(fx):
    return features.late_target(fx.invoices, fx.payments, 7).select(
        "invoice_id", "customer_id", "due_date", "payment_date", "days_late", "is_late"
    )


_DOUBLE_FEATURES = [
    "invoice_amount_log", "invoice_amount_sqrt", "credit_limit_log", "credit_utilization", "customer_avg_days_late",
    "customer_late_rate", "customer_ar_concentration", "amount_x_days_until_due", "amount_x_late_rate",
    "utilization_x_late_rate", "customer_avg_payment_amount",
]
_INT_FEATURES = [c for c in features.FEATURE_COLUMNS if c not in _DOUBLE_FEATURES]


def _r6(x: str) -> str:
    return round_dec(x, 6)


FEATURES_SQL = f"""WITH h AS ({HIST_SQL}),
ca AS (SELECT customer_id, sum(CAST(invoice_amount AS decimal(18,2))) AS customer_total_ar FROM invoices WHERE status = 'open' GROUP BY customer_id),
tot AS (SELECT sum(CASE WHEN status = 'open' THEN CAST(invoice_amount AS decimal(18,2)) END) AS total_ar FROM invoices),
b AS (
  SELECT i.invoice_id, i.customer_id, i.status, i.invoice_amount, i.invoice_type, i.channel, i.issue_date, i.due_date,
         c.credit_limit, h.customer_invoice_count AS hc, h.customer_avg_days_late AS ha, h.customer_late_rate AS hl,
         h.customer_avg_payment_amount AS hp, ca.customer_total_ar, tot.total_ar,
         CAST(date_diff('day', {A}, i.due_date) AS int) AS days_until_due, ln(1 + i.invoice_amount) AS lg,
         least(2.0, greatest(0.0, coalesce(CASE WHEN c.credit_limit = 0 THEN CASE WHEN i.invoice_amount > 0 THEN 2.0 ELSE 0.0 END
                                            ELSE i.invoice_amount / c.credit_limit END, 0.0))) AS util
  FROM invoices i LEFT JOIN customers c ON i.customer_id = c.customer_id LEFT JOIN ca ON i.customer_id = ca.customer_id
       LEFT JOIN h ON i.customer_id = h.customer_id, tot)
SELECT invoice_id, customer_id, status, invoice_amount,
       CASE WHEN invoice_amount <= 0 THEN NULL WHEN invoice_amount <= 1000 THEN 'tiny' WHEN invoice_amount <= 5000 THEN 'small'
            WHEN invoice_amount <= 10000 THEN 'medium' WHEN invoice_amount <= 50000 THEN 'large' WHEN invoice_amount > 50000 THEN 'xlarge' END AS amount_bucket,
       days_until_due, CAST(date_diff('day', issue_date, {A}) AS int) AS days_since_issue,
       CAST(date_diff('day', issue_date, due_date) AS int) AS payment_term_days,
       CAST(month(issue_date) AS int) AS issue_month, CAST(quarter(issue_date) AS int) AS issue_quarter,
       CAST(isodow(issue_date) - 1 AS int) AS issue_day_of_week,
       CAST(isodow(issue_date) >= 6 AS int) AS issue_is_weekend,
       CAST(month(due_date) AS int) AS due_month, CAST(quarter(due_date) AS int) AS due_quarter,
       CAST(isodow(due_date) - 1 AS int) AS due_day_of_week,
       CAST(isodow(due_date) >= 6 AS int) AS due_is_weekend,
       {_r6('lg')} AS invoice_amount_log, {_r6('sqrt(invoice_amount)')} AS invoice_amount_sqrt,
       {_r6('ln(1 + credit_limit)')} AS credit_limit_log, {_r6('util')} AS credit_utilization,
       CAST(coalesce(hc, 1) AS bigint) AS customer_invoice_count, {_r6('coalesce(ha, 0.0)')} AS customer_avg_days_late,
       {_r6('coalesce(hl, 0.0)')} AS customer_late_rate,
       {_r6('CASE WHEN total_ar > 0 THEN coalesce(CAST(customer_total_ar AS double) / CAST(total_ar AS double) * 100, 0.0) ELSE 0.0 END')} AS customer_ar_concentration,
       CAST(invoice_type = 'recurring' AS int) AS invoice_type_recurring, CAST(invoice_type = 'milestone' AS int) AS invoice_type_milestone,
       CAST(channel = 'online' AS int) AS channel_online,
       {_r6('lg * days_until_due')} AS amount_x_days_until_due, {_r6('lg * coalesce(hl, 0.0)')} AS amount_x_late_rate,
       {_r6('util * coalesce(hl, 0.0)')} AS utilization_x_late_rate,
       {_r6('coalesce(hp, invoice_amount)')} AS customer_avg_payment_amount,
       CAST(customer_total_ar AS double) AS customer_total_ar
FROM b"""


@register("features", "FE-1 / FN-10", FEATURES_SQL, views=FV)
def q_features(fx):
    f = features.engineer_features(fx.invoices, fx.customers, fx.payments, AS_OF)
    return f.select(
        "invoice_id", "customer_id", "status", "invoice_amount", "amount_bucket",
        *[F.col(c).cast("int").alias(c) for c in _INT_FEATURES if c != "customer_invoice_count"],
        F.col("customer_invoice_count").cast("long").alias("customer_invoice_count"),
        *[E.round_dec(c, 6).alias(c) for c in _DOUBLE_FEATURES],
        "customer_total_ar",
    )


@register(
    "model_split", "ML-1 / ML-2",
    f"""WITH l AS (
  SELECT i.issue_date, coalesce(p.payment_date IS NOT NULL AND {days_late('p.payment_date', 'i.due_date')} > 7, false) AS late
  FROM invoices i LEFT JOIN payments p ON i.invoice_id = p.invoice_id WHERE i.issue_date IS NOT NULL),
c AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', issue_date), 0.75) AS cut FROM l),
t AS (SELECT l.*, date_diff('day', DATE '1970-01-01', issue_date) <= cut AS is_train FROM l, c),
h AS (SELECT DATE '1970-01-01' + CAST(floor(any_value(cut)) AS INTEGER) AS cutoff_date, count(*) FILTER (WHERE is_train) AS train_samples,
             count(*) FILTER (WHERE NOT is_train) AS test_samples, {round_dec('avg(CAST(late AS int)) * 100', 2)} AS late_rate FROM t, c),
n AS (SELECT late, count(*) AS n FROM t WHERE is_train GROUP BY late)
SELECT CAST(fold AS INTEGER) AS fold, CAST(late AS INTEGER) AS is_late, n // 5 + CAST(fold < n % 5 AS BIGINT) AS fold_rows,
       CAST(cutoff_date AS DATE) AS cutoff_date, train_samples, test_samples, late_rate
FROM n, range(5) f(fold), h WHERE n // 5 + CAST(fold < n % 5 AS BIGINT) > 0""",
    views=("invoices", "payments"),
)
def q_model_split(fx):
    return model.split(fx.invoices, fx.customers, fx.payments, AS_OF)


# Model queries: rows-only checks (MLlib vs no oracle); tests/test_model.py checks their values' properties. One fit of the
# full model (100 trees, 5 folds) per (session, data dir) is reused by the five queries.
_TRAINED: dict[tuple[str, str], model.TrainedModel] = {}


def trained(fx) -> model.TrainedModel:
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir)
    if key not in _TRAINED:
        ensure_checkpoint_dir(fx.spark)
        _TRAINED[key] = model.train(fx.invoices, fx.customers, fx.payments, AS_OF)
    return _TRAINED[key]


@register("model_metrics", "ML-1 / ML-3")
def q_model_metrics(fx):
    return trained(fx).metrics


@register("model_cv", "ML-2")
def q_model_cv(fx):
    return trained(fx).cv


@register("feature_importance", "ML-4")
def q_feature_importance(fx):
    return trained(fx).importances


@register("model_scores", "ML-5 / ML-6")
def q_model_scores(fx):
    return model.score_open_invoices(trained(fx).model, fx.invoices, fx.customers, fx.payments, AS_OF)


@register("predicted_payment", "ML-7")
def q_predicted_payment(fx):
    scored = model.score_open_invoices(trained(fx).model, fx.invoices, fx.customers, fx.payments, AS_OF)
    return model.predict_payment_date(scored).select("invoice_id", "due_date", "p_late", "predicted_payment_date")
