"""Collection recommendations (RC-1..RC-8): every rule ladder is one CASE expression in the projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E


def prior_action_counts(actions: DataFrame) -> DataFrame:
    """RC-1: number of logged actions per invoice (map-side partial counts, so busy invoices are cheap)."""
    return actions.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("prior_actions"))


def determine_action(days, risk, prior, high_value, max_reminders: int = 5, not_due_action: str | None = None):
    """RC-2: the action ladder, in the reference's order (D9: not-yet-due, low-risk invoices fall through to the
    45+ branch unless ``not_due_action`` is given)."""
    d, r, p, hv = E.col(days), E.col(risk), E.col(prior), E.col(high_value)
    ladder = F.when(p >= max_reminders, "escalate").when((d <= 0) & (r >= 70), "friendly_reminder")
    if not_due_action is not None:
        ladder = ladder.when(d <= 0, not_due_action)
    return (
        ladder.when((d > 0) & (d <= 3), F.when(p == 0, "friendly_reminder").otherwise("second_reminder"))
        .when((d >= 4) & (d <= 10), F.when(p == 0, "reminder_with_inquiry").otherwise("call"))
        .when((d >= 11) & (d <= 20), F.when(hv, "call").otherwise("firm_reminder"))
        .when((d >= 21) & (d <= 45), F.when(p < 2, "payment_plan_offer").otherwise("pause_service_warning"))
        .otherwise(F.when(hv, "escalate").otherwise("final_notice"))
    )


def priority(days, risk, amount, prior):
    """RC-3: int(0.4 overdue + 0.3 risk + 0.2 amount + 0.1 prior actions), truncated."""
    overdue_score = F.least(F.lit(100.0), E.col(days) / 90 * 100)
    amount_score = F.least(F.lit(100.0), E.col(amount) / 50000 * 100)
    actions_score = F.least(F.lit(100.0), E.col(prior) / 5 * 100)
    return (overdue_score * 0.4 + E.col(risk) * 0.3 + amount_score * 0.2 + actions_score * 0.1).cast("int")


def urgency(prio):
    """RC-4."""
    p = E.col(prio)
    return F.when(p >= 75, "critical").when(p >= 50, "high").when(p >= 25, "medium").otherwise("low")


def tone(days, prior, high_value):
    """RC-5 (order matters)."""
    d, p, hv = E.col(days), E.col(prior), E.col(high_value)
    return (
        F.when(hv & (d < 15), "friendly")
        .when((d <= 7) & (p == 0), "friendly")
        .when((p >= 2) | (d >= 30), "firm")
        .otherwise("neutral")
    )


def recommend_actions(
    scored: DataFrame, customers: DataFrame, actions: DataFrame | None, as_of,
    high_value_threshold: float = 10000, max_reminders: int = 5, not_due_action: str | None = None,
) -> DataFrame:
    """RC-6: recommendation table for open invoices, highest priority first (ties by invoice_id).

    ``scored`` may carry ``risk_score``; without it the neutral default 50 applies. Where it carries the customer's
    ``name`` already, the customers are not joined again.
    """
    df = scored.where(F.col("status") == "open").withColumn("days_overdue", E.days_overdue("due_date", as_of))
    if "risk_score" not in df.columns:
        df = df.withColumn("risk_score", F.lit(50))
    if "name" not in df.columns:
        df = df.join(customers.select("customer_id", "name"), "customer_id", "left")
    if actions is not None:
        df = df.join(prior_action_counts(actions), "invoice_id", "left").withColumn(
            "prior_actions", F.coalesce(F.col("prior_actions"), F.lit(0)).cast("int")
        )
    else:
        df = df.withColumn("prior_actions", F.lit(0))
    risk = F.coalesce(F.col("risk_score"), F.lit(50))
    df = df.withColumn("is_high_value", F.col("invoice_amount") >= high_value_threshold)
    df = df.withColumn(
        "recommended_action",
        determine_action("days_overdue", risk, "prior_actions", "is_high_value", max_reminders, not_due_action),
    )
    df = df.withColumn("action_priority", priority("days_overdue", risk, "invoice_amount", "prior_actions"))
    df = df.withColumn("urgency", urgency("action_priority"))
    df = df.withColumn("message_tone", tone("days_overdue", "prior_actions", "is_high_value"))
    return df.orderBy(F.desc("action_priority"), "invoice_id")


def top_recommendations(recs: DataFrame, top_n: int = 30, min_priority: int = 0) -> DataFrame:
    """RC-7: the ``top_n`` highest-priority rows at or above ``min_priority`` (a TakeOrderedAndProject)."""
    return recs.where(F.col("action_priority") >= min_priority).orderBy(F.desc("action_priority"), "invoice_id").limit(top_n)


def next_contact(open_scored: DataFrame, contact_log: DataFrame, as_of, keep_columns: bool = False) -> DataFrame:
    """RC-8: next outreach step from days overdue, risk and the types of contacts already made.

    The contact history reduces to a count and one flag per relevant type (``bool_or`` partial aggregates), so a
    heavily contacted invoice never materialises its list of past actions.
    """
    hist = contact_log.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("n_prev"),
        F.bool_or(F.col("action_type") == "friendly_reminder").alias("had_friendly"),
        F.bool_or(F.col("action_type") == "second_notice").alias("had_second"),
        F.bool_or(F.col("action_type") == "call_request").alias("had_call"),
    )
    df = open_scored.join(hist, "invoice_id", "left")
    d = E.days_overdue("due_date", as_of)
    r = F.col("risk_score")
    n = F.coalesce(F.col("n_prev"), F.lit(0))
    fr, sn, cr = (F.coalesce(F.col(c), F.lit(False)) for c in ("had_friendly", "had_second", "had_call"))
    action = (
        F.when((d <= 7) & (r < 50), "friendly_reminder")
        .when((d <= 15) & fr, "second_notice")
        .when((d <= 30) & sn, F.when(r >= 70, "call_request").otherwise("payment_plan"))
        .when((d <= 60) & cr, "payment_plan")
        .when((d > 60) | (r >= 90), "escalate")
        .when(n == 0, "friendly_reminder")
        .when(n == 1, "second_notice")
        .when(n == 2, "call_request")
        .otherwise("escalate")
    )
    extra = [c for c in open_scored.columns if c not in ("invoice_id", "customer_id", "risk_score")] if keep_columns else []
    return df.select(
        "invoice_id", "customer_id", *extra, d.alias("days_overdue"), "risk_score",
        n.cast("long").alias("previous_contacts"), action.alias("next_action"),
    )


def recommendations_by_week(recs: DataFrame, week_date, top_n: int = 30) -> DataFrame:
    """RC-7 by-week variant: the reference returns the top N regardless of the week (``week_date`` is unused)."""
    del week_date
    return top_recommendations(recs, top_n)
