"""Registered queries: AR metrics, dashboard reports and forecasting (AR-5..11, DB-*, FC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from receivables.operators import forecast, metrics, reports
from receivables.plans.catalog import AS_OF, AS_OF_SQL, register
from receivables.plans.sqlfrag import days_late, bucket5, money2, msum, overdue, pct, round_dec

A = AS_OF_SQL
DEC = "CAST(invoice_amount AS decimal(18,2))"


def sum_when(cond: str, amount: str = DEC) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN {amount} END), 0)"


DSO_SQL = f"""(SELECT CASE WHEN period_sales = 0 THEN 0.0
        ELSE {round_dec('CAST(current_ar AS double) / CAST(period_sales AS double) * 90', 2)} END AS dso
 FROM (SELECT {sum_when("status = 'open'")} AS current_ar, {sum_when(f'issue_date >= {A} - 90')} AS period_sales
       FROM invoices) a)"""

CEI_SQL = f"""(SELECT CASE WHEN den = 0 THEN 100.0
        ELSE {round_dec('greatest(0.0, least(100.0, num / den * 100))', 2)} END AS cei
 FROM (SELECT CAST(b + s - e AS double) AS num, CAST(b + s - ec AS double) AS den FROM (
   SELECT {sum_when(f"issue_date < {A} - 90 AND status = 'open'")} AS b,
          {sum_when(f'issue_date >= {A} - 90 AND issue_date < {A}')} AS s,
          {sum_when("status = 'open'")} AS e,
          {sum_when(f"status = 'open' AND due_date >= {A}")} AS ec
   FROM invoices) x) y)"""

BEHAVIOR_SQL = f"""(SELECT total_invoices, paid_invoices,
       coalesce({pct('paid_invoices', 'total_invoices')}, 0.0) AS payment_rate,
       {round_dec('avg_dtp', 2)} AS avg_days_to_payment,
       {round_dec('med_dtp', 2)} AS median_days_to_payment,
       late_payment_count,
       coalesce({pct('late_payment_count', 'paid_invoices')}, 0.0) AS late_payment_rate,
       coalesce({round_dec('avg_late', 2)}, 0.0) AS avg_days_late,
       coalesce({round_dec('med_late', 2)}, 0.0) AS median_days_late,
       CAST(coalesce(max_late, 0) AS int) AS max_days_late
 FROM (SELECT count(*) AS total_invoices FROM invoices) t,
      (SELECT count(*) AS paid_invoices, avg(dtp) AS avg_dtp, median(dtp) AS med_dtp,
              count(*) FILTER (WHERE dl > 0) AS late_payment_count,
              avg(CASE WHEN dl > 0 THEN dl END) AS avg_late, median(CASE WHEN dl > 0 THEN dl END) AS med_late,
              max(CASE WHEN dl > 0 THEN dl END) AS max_late
       FROM (SELECT date_diff('day', i.issue_date, p.payment_date) AS dtp,
                    {days_late('p.payment_date', 'i.due_date')} AS dl
             FROM invoices i JOIN payments p ON i.invoice_id = p.invoice_id) q) pr)"""


@register("dso", "AR-5", f"SELECT * FROM {DSO_SQL} d", views=("invoices",))
def q_dso(fx):
    return metrics.dso(fx.invoices, AS_OF)


@register(
    "dso_anchored", "AR-6",
    f"""
SELECT CASE WHEN rr > 0 THEN CASE WHEN rr / 90 > 0 THEN oa / (rr / 90) ELSE 0.0 END ELSE 0.0 END AS dso
FROM (SELECT CAST({sum_when("status = 'open'")} AS double) AS oa,
             CAST({sum_when('issue_date >= m - 90')} AS double) AS rr
      FROM invoices, (SELECT max(issue_date) AS m FROM invoices) mx) x""",
    views=("invoices",),
)
def q_dso_anchored(fx):
    return metrics.dso_anchored(fx.invoices)


@register("cei", "AR-7", f"SELECT * FROM {CEI_SQL} c", views=("invoices",))
def q_cei(fx):
    return metrics.cei(fx.invoices, AS_OF)


@register("payment_behavior", "AR-8", f"SELECT * FROM {BEHAVIOR_SQL} b", views=("invoices", "payments"))
def q_payment_behavior(fx):
    return metrics.payment_behavior(fx.invoices, fx.payments)


@register(
    "payment_behavior_status", "AR-9",
    f"""
SELECT total_invoices, paid_invoices, coalesce({pct('paid_invoices', 'total_invoices')}, 0.0) AS payment_rate
FROM (SELECT count(*) AS total_invoices, count(*) FILTER (WHERE status = 'paid') AS paid_invoices FROM invoices) t""",
    views=("invoices",),
)
def q_payment_behavior_status(fx):
    return metrics.payment_behavior_from_status(fx.invoices)


@register(
    "customer_risk", "AR-10",
    f"""
WITH base AS (
  SELECT customer_id, count(*) AS total_invoices, count(*) FILTER (WHERE status = 'open') AS open_invoices,
         coalesce(sum(CASE WHEN status = 'open' THEN {DEC} END), 0) AS ar_dec
  FROM invoices GROUP BY customer_id),
hist AS (
  SELECT customer_id, count(*) AS paid_invoices, count(*) FILTER (WHERE dl > 0) AS late_invoices, avg(dl) AS avg_late_raw
  FROM (SELECT i.customer_id, {days_late('p.payment_date', 'i.due_date')} AS dl
        FROM invoices i JOIN payments p ON i.invoice_id = p.invoice_id) q GROUP BY customer_id),
b AS (
  SELECT base.customer_id, total_invoices, open_invoices, ar_dec,
         coalesce(paid_invoices, 0) AS paid_invoices, coalesce(late_invoices, 0) AS late_invoices,
         coalesce({pct('late_invoices', 'paid_invoices')}, 0.0) AS late_rate,
         coalesce({round_dec('avg_late_raw', 2)}, 0.0) AS avg_days_late
  FROM base LEFT JOIN hist ON base.customer_id = hist.customer_id
  WHERE base.customer_id IN (SELECT customer_id FROM customers)),
s AS (
  SELECT b.*, CASE WHEN all_ar > 0 THEN {pct('CAST(ar_dec AS double)', 'CAST(all_ar AS double)')} ELSE 0.0 END AS ar_concentration
  FROM b, (SELECT sum(ar_dec) AS all_ar FROM b) t)
SELECT s.customer_id, c.name, total_invoices, open_invoices, CAST(ar_dec AS double) AS total_ar, paid_invoices,
       late_invoices, late_rate, avg_days_late, ar_concentration,
       {round_dec('late_rate * 0.4 + least(avg_days_late / 90 * 100, 100.0) * 0.3 + least(ar_concentration, 100.0) * 0.2 + least(open_invoices / 10 * 100, 100.0) * 0.1', 2)} AS risk_score
FROM s JOIN customers c ON s.customer_id = c.customer_id""",
    views=("invoices", "payments", "customers"),
)
def q_customer_risk(fx):
    return metrics.customer_risk(fx.invoices, fx.customers, fx.payments)


@register(
    "ar_summary", "AR-11",
    f"""
SELECT h.*, d.*, c.*, b.*
FROM (SELECT CAST(ar AS double) AS total_ar, open_invoices, CAST(od AS double) AS overdue_ar, overdue_invoices,
             CASE WHEN ar > 0 THEN {pct('CAST(od AS double)', 'CAST(ar AS double)')} ELSE 0.0 END AS overdue_percentage,
             coalesce({round_dec('avg_open', 2)}, 0.0) AS avg_invoice_amount
      FROM (SELECT {sum_when("status = 'open'")} AS ar, count(*) FILTER (WHERE status = 'open') AS open_invoices,
                   {sum_when(f"status = 'open' AND due_date < {A}")} AS od,
                   count(*) FILTER (WHERE status = 'open' AND due_date < {A}) AS overdue_invoices,
                   avg(CASE WHEN status = 'open' THEN {DEC} END) AS avg_open
            FROM invoices) x) h,
     {DSO_SQL} d, {CEI_SQL} c, {BEHAVIOR_SQL} b""",
    views=("invoices", "payments"),
)
def q_ar_summary(fx):
    return metrics.ar_summary(fx.invoices, fx.payments, AS_OF)


def _compact(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN '$0' WHEN abs({v}) >= 1000000 THEN printf('$%.2fM', {v} / 1000000) "
        f"WHEN abs({v}) >= 1000 THEN printf('$%.1fK', {v} / 1000) ELSE printf('$%.2f', {v}) END"
    )


@register(
    "dash_kpis", "DB-1 / DB-4 / FN-11",
    f"""
WITH h AS (
  SELECT CAST(coalesce(sum(CASE WHEN status = 'open' THEN {DEC} END), 0) AS double) AS total_ar,
         CAST(coalesce(sum(CASE WHEN status = 'open' AND due_date < {A} THEN {DEC} END), 0) AS double) AS overdue_ar,
         count(*) FILTER (WHERE status = 'paid') AS paid_n, count(*) AS all_n,
         count(*) FILTER (WHERE status = 'open') AS open_invoices,
         avg(CASE WHEN status = 'open' THEN {days_late(A, 'due_date')} END) AS avg_od_days
  FROM invoices),
dd AS (
  SELECT CASE WHEN rr > 0 THEN CASE WHEN rr / 90 > 0 THEN oa / (rr / 90) ELSE 0.0 END ELSE 0.0 END AS dso
  FROM (SELECT CAST({sum_when("status = 'open'")} AS double) AS oa, CAST({sum_when('issue_date >= m - 90')} AS double) AS rr
        FROM invoices, (SELECT max(issue_date) AS m FROM invoices) mx) x)
SELECT total_ar, {_compact('total_ar')} AS total_ar_text, overdue_ar, {_compact('overdue_ar')} AS overdue_ar_text,
       CASE WHEN total_ar > 0 THEN {round_dec('overdue_ar / total_ar * 100', 2)} ELSE 0.0 END AS overdue_pct,
       {round_dec('dso', 2)} AS dso,
       coalesce({pct('paid_n', 'all_n')}, 0.0) AS collection_rate, open_invoices,
       {money2('total_ar / NULLIF(open_invoices, 0)')} AS avg_open_invoice,
       {_compact(money2('total_ar / NULLIF(open_invoices, 0)'))} AS avg_open_invoice_text,
       (SELECT count(*) FROM customers) AS total_customers,
       {round_dec('avg_od_days', 2)} AS avg_days_overdue
FROM h, dd""",
    views=("invoices", "customers"),
)
def q_dash_kpis(fx):
    return reports.dash_kpis(fx.invoices, fx.customers, AS_OF)


@register(
    "dash_aging", "DB-2 / FN-3",
    f"""
SELECT aging_bucket, amount, invoice_count,
       {pct('amount', 'CAST(sum(CAST(amount AS decimal(28,2))) OVER () AS double)')} AS percentage
FROM (SELECT {bucket5(overdue('due_date', A))} AS aging_bucket, {msum('invoice_amount')} AS amount,
             count(invoice_id) AS invoice_count
      FROM invoices WHERE status = 'open' GROUP BY 1) g""",
    views=("invoices",),
)
def q_dash_aging(fx):
    return reports.dash_aging(fx.invoices, AS_OF)


@register(
    "monthly_payments", "DB-3",
    f"SELECT CAST(date_trunc('month', payment_date) AS DATE) AS month, {msum('amount')} AS amount FROM payments WHERE payment_date IS NOT NULL GROUP BY 1",
    views=("payments",),
)
def q_monthly_payments(fx):
    return reports.monthly_payments(fx.payments)


@register(
    "top_customers_ar", "DB-5",
    f"""SELECT customer_id, {msum('invoice_amount')} AS outstanding_ar FROM invoices WHERE status = 'open' AND customer_id IS NOT NULL
GROUP BY customer_id ORDER BY outstanding_ar DESC, customer_id LIMIT 10""",
    views=("invoices",),
)
def q_top_customers_ar(fx):
    return reports.top_customers_ar(fx.invoices, 10)


@register(
    "status_distribution", "DB-6",
    "SELECT status, count(*) AS invoice_count FROM invoices WHERE status IS NOT NULL GROUP BY status",
    views=("invoices",),
)
def q_status_distribution(fx):
    return reports.status_distribution(fx.invoices)


@register(
    "customer_summary", "DB-7",
    f"""
SELECT customer_id, total_invoices, CAST(tot AS double) AS total_amount,
       {money2('CAST(tot AS double) / n_amt')} AS avg_invoice, max_invoice,
       CAST(coalesce(open_dec, 0) AS double) AS open_ar
FROM (SELECT customer_id, count(invoice_id) AS total_invoices, sum({DEC}) AS tot, count(invoice_amount) AS n_amt,
             max(invoice_amount) AS max_invoice, sum(CASE WHEN status = 'open' THEN {DEC} END) AS open_dec
      FROM invoices WHERE customer_id IS NOT NULL GROUP BY customer_id) g
ORDER BY total_amount DESC, customer_id LIMIT 50""",
    views=("invoices",),
)
def q_customer_summary(fx):
    return reports.customer_summary(fx.invoices, 50)


@register(
    "invoice_timeline", "DB-8",
    f"""SELECT CAST(date_trunc('month', issue_date) AS DATE) AS month, count(*) AS invoice_count,
       {msum('invoice_amount')} AS invoice_value FROM invoices WHERE issue_date IS NOT NULL GROUP BY 1""",
    views=("invoices",),
)
def q_invoice_timeline(fx):
    return reports.invoice_timeline(fx.invoices)


@register(
    "credit_utilization", "DB-8",
    f"""
SELECT c.customer_id, c.name, c.credit_limit, CAST(coalesce(a.ar, 0) AS double) AS open_ar,
       {pct('CAST(coalesce(a.ar, 0) AS double)', 'CASE WHEN c.credit_limit != 0 THEN c.credit_limit END')} AS utilization_pct
FROM customers c LEFT JOIN (SELECT customer_id, sum({DEC}) AS ar FROM invoices WHERE status = 'open' GROUP BY customer_id) a
  ON c.customer_id = a.customer_id""",
    views=("invoices", "customers"),
)
def q_credit_utilization(fx):
    return reports.credit_utilization(fx.invoices, fx.customers)


@register(
    "ar_concentration", "DB-8",
    f"""
WITH a AS (SELECT customer_id, sum({DEC}) AS ar FROM invoices WHERE status = 'open' AND customer_id IS NOT NULL GROUP BY customer_id)
SELECT customer_id, CAST(ar AS double) AS open_ar,
       {pct('CAST(ar AS double)', 'CAST(all_ar AS double)')} AS share_pct
FROM a, (SELECT sum(ar) AS all_ar FROM a) t""",
    views=("invoices",),
)
def q_ar_concentration(fx):
    return reports.ar_concentration(fx.invoices)


@register(
    "invoice_explorer", "FN-12",
    """SELECT invoice_id, customer_id, invoice_amount, issue_date, due_date, status FROM invoices
WHERE status IN ('open', 'void') AND coalesce(contains(lower(customer_id), 'st-00000'), false)
  AND invoice_amount >= 1000
ORDER BY due_date DESC, invoice_id""",
    views=("invoices",),
)
def q_invoice_explorer(fx):
    # Case-insensitive search: the text stands in upper case in the ids of the customers 0 to 99, and in no others.
    return reports.invoice_explorer(fx.invoices, ("open", "void"), "St-00000", 1000)


@register(
    "dataset_profile", "DB-9",
    f"""
WITH st AS (SELECT status, count(*) AS n FROM invoices GROUP BY status),
tot AS (SELECT count(*) AS all_n, sum(CASE WHEN status = 'open' THEN {DEC} END) AS ar, sum({DEC}) AS tot FROM invoices)
SELECT 'status_count' AS metric, status AS key, CAST(n AS double) AS value FROM st
UNION ALL SELECT 'status_pct', status, {pct('n', 'all_n', 1)} FROM st, tot
UNION ALL SELECT 'total_invoices', NULL, CAST(all_n AS double) FROM tot
UNION ALL SELECT 'total_ar', NULL, CAST(coalesce(ar, 0) AS double) FROM tot
UNION ALL SELECT 'avg_invoice', NULL, {money2('CAST(tot AS double) / all_n')} FROM tot
UNION ALL SELECT 'late_payment_rate', NULL,
  {pct("count(*) FILTER (WHERE date_diff('day', i.due_date, p.payment_date) > 0)", 'count(*)', 1)}
  FROM payments p JOIN invoices i ON p.invoice_id = i.invoice_id
UNION ALL SELECT 'total_payments', NULL, CAST(count(*) AS double) FROM payments
UNION ALL SELECT 'total_customers', NULL, CAST(count(*) AS double) FROM customers
UNION ALL SELECT 'industry_customers', industry, CAST(count(*) AS double) FROM customers GROUP BY industry""",
    views=("invoices", "payments", "customers"),
)
def q_dataset_profile(fx):
    return reports.dataset_profile(fx.invoices, fx.payments, fx.customers)


PATTERN_SQL = """(SELECT CASE WHEN pairs = 0 THEN 7.0 ELSE avg_d END AS avg_days_after_due,
        CASE WHEN pairs = 0 THEN 14.0 ELSE std_d END AS std_days_after_due,
        CASE WHEN pairs = 0 OR n_invoices = 0 THEN 0.8 ELSE pairs / n_invoices END AS payment_probability
 FROM (SELECT count(*) AS pairs, avg(date_diff('day', i.due_date, p.payment_date)) AS avg_d,
              stddev_samp(date_diff('day', i.due_date, p.payment_date)) AS std_d
       FROM invoices i JOIN payments p ON i.invoice_id = p.invoice_id) x,
      (SELECT count(*) AS n_invoices FROM invoices) y)"""


@register(
    "payment_pattern", "FC-1",
    f"""SELECT {round_dec('avg_days_after_due', 6)} AS avg_days_after_due,
       {round_dec('std_days_after_due', 6)} AS std_days_after_due,
       {round_dec('payment_probability', 6)} AS payment_probability FROM {PATTERN_SQL} p""",
    views=("invoices", "payments"),
)
def q_payment_pattern(fx):
    from receivables.functions import expr as E

    p = forecast.payment_pattern(fx.invoices, fx.payments)
    return p.select(*[E.round_dec(c, 6).alias(c) for c in p.columns])


@register(
    "forecast_inflows", "FC-2",
    f"""
SELECT {money2('CAST(s7 AS double) * payment_probability')} AS forecast_7d,
       {money2('CAST(s14 AS double) * payment_probability')} AS forecast_14d,
       {money2('CAST(s30 AS double) * payment_probability')} AS forecast_30d
FROM (SELECT {sum_when(f"date_diff('day', {A}, due_date + CAST(trunc(avg_days_after_due) AS int)) <= 7")} AS s7,
             {sum_when(f"date_diff('day', {A}, due_date + CAST(trunc(avg_days_after_due) AS int)) <= 14")} AS s14,
             {sum_when(f"date_diff('day', {A}, due_date + CAST(trunc(avg_days_after_due) AS int)) <= 30")} AS s30
      FROM invoices, {PATTERN_SQL} p WHERE status = 'open') s, {PATTERN_SQL} p2""",
    views=("invoices", "payments"),
)
def q_forecast_inflows(fx):
    return forecast.forecast_inflows(fx.invoices, fx.payments, AS_OF)


def _u(chunk: int) -> str:
    return f"((CAST(('0x' || substr(h, {1 + 8 * chunk}, 8)) AS BIGINT) + 1) / 4294967297.0)"


SCEN_SQL = f"""(
SELECT CAST(s.scenario AS int) AS scenario, CAST(coalesce(t.tc, 0) AS double) AS total_collected, 30 AS days_ahead
FROM range(1, 101) s(scenario) LEFT JOIN (
  SELECT scenario, sum(CAST(invoice_amount AS decimal(18,2))) AS tc
  FROM (SELECT s.scenario, i.invoice_amount, i.due_date, p.*,
               md5(concat_ws('|', i.invoice_id, CAST(s.scenario AS VARCHAR), '42')) AS h
        FROM invoices i, {PATTERN_SQL} p, range(1, 101) s(scenario)
        WHERE i.status = 'open' AND i.due_date <= {A} + 30) x
  WHERE {_u(0)} < payment_probability
    AND date_diff('day', {A}, due_date + CAST(trunc(greatest(0.0, avg_days_after_due + std_days_after_due *
          sqrt(-2.0 * ln({_u(1)})) * cos(2 * pi() * {_u(2)}))) AS int)) BETWEEN 0 AND 30
  GROUP BY scenario) t ON s.scenario = t.scenario)"""


@register("cash_scenarios", "FC-3", f"SELECT * FROM {SCEN_SQL} x", views=("invoices", "payments"))
def q_cash_scenarios(fx):
    return forecast.cash_scenarios(fx.invoices, fx.payments, AS_OF, n_scenarios=100, days_ahead=30, seed=42)


@register(
    "scenario_percentiles", "FC-4",
    f"""SELECT {money2('quantile_cont(total_collected, 0.1)')} AS p10, {money2('quantile_cont(total_collected, 0.5)')} AS p50,
       {money2('quantile_cont(total_collected, 0.9)')} AS p90, {money2('avg(total_collected)')} AS mean
FROM {SCEN_SQL} x""",
    views=("invoices", "payments"),
)
def q_scenario_percentiles(fx):
    return forecast.scenario_percentiles(
        forecast.cash_scenarios(fx.invoices, fx.payments, AS_OF, n_scenarios=100, days_ahead=30, seed=42)
    )


@register(
    "collection_impact", "FC-5",
    f"""
SELECT CAST(tot AS double) AS total_targeted, {money2('CAST(tot AS double) * 0.9')} AS expected_collection,
       CAST(0.9 AS double) AS success_probability, invoice_count
FROM (SELECT coalesce(sum({DEC}), 0) AS tot, count(*) AS invoice_count FROM invoices
      WHERE invoice_id IN (SELECT invoice_id FROM invoices WHERE status = 'open' AND date_diff('day', due_date, {A}) > 90)) t""",
    views=("invoices",),
)
def q_collection_impact(fx):
    # The campaign targets every open invoice more than 90 days overdue.
    ids = fx.invoices.where((F.col("status") == "open") & (F.datediff(F.lit(AS_OF), "due_date") > 90)).select("invoice_id")
    return forecast.collection_impact(fx.invoices, ids, 0.9)


@register(
    "cash_gap", "FC-6",
    f"""
SELECT CAST(ar AS double) AS total_ar, {money2('CAST(soon AS double) * 0.8')} AS expected_collections,
       {money2('CAST(ar AS double) - CAST(soon AS double) * 0.8')} AS cash_gap,
       CASE WHEN ar > 0 THEN {round_dec('(CAST(ar AS double) - CAST(soon AS double) * 0.8) / CAST(ar AS double) * 100', 2)} ELSE 0.0 END AS gap_percentage,
       30 AS forecast_days
FROM (SELECT coalesce(sum({DEC}), 0) AS ar, {sum_when(f'due_date >= {A} AND due_date <= {A} + 30')} AS soon
      FROM invoices WHERE status = 'open') g""",
    views=("invoices",),
)
def q_cash_gap(fx):
    return forecast.cash_gap(fx.invoices, AS_OF, 30)
