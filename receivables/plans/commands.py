"""The reference's commands as compositions of operators. Each returns lazy DataFrames;
writing is left to the caller (``sources.tables.save``), so a command is one Spark plan per output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import (
    aging, audit, forecast, metrics, model, outreach, quality, recommend, schedule, scoring,
)
from receivables.sources import tables


def validate(customers: DataFrame, invoices: DataFrame, payments: DataFrame | None) -> DataFrame:
    """validate: DQ-13 per-table verdicts."""
    v = quality.validate_all(customers, invoices, payments)
    t = {"customers": customers, "invoices": invoices}
    if payments is not None:
        t["payments"] = payments
    return quality.summary(v, t)


def analyze(invoices: DataFrame, payments: DataFrame | None, as_of) -> DataFrame:
    """analyze: AR summary + aging summary as one report row (SNK-4 shape)."""
    return tables.report(metrics.ar_summary(invoices, payments, as_of), aging.aging_summary(invoices, as_of), as_of)


def train(customers, invoices, payments, as_of, model_type: str = "gradient_boost", **params) -> model.TrainedModel:
    """train: FE-3 -> FE-1 -> ML-1..4 (save with ``model.save``)."""
    return model.train(invoices, customers, payments, as_of, model_type=model_type, **params)


def score(customers, invoices, payments, as_of, fitted=None, top: int = 20) -> DataFrame:
    """score: ML-6 (model when given, rules otherwise), highest risk first, top ``top``."""
    return scoring.score_invoices(invoices, customers, payments, as_of, fitted).orderBy(
        F.desc("risk_score"), "invoice_id"
    ).limit(top)


def plan(customers, invoices, payments, actions, as_of, fitted=None, top: int = 30) -> DataFrame:
    """plan: ML-6 -> RC-6 -> top N."""
    if fitted is None:
        scored = scoring.rule_risk_scores(invoices, customers, as_of, sort=False, carry=("name",))
    else:
        scored = scoring.score_invoices(invoices, customers, payments, as_of, fitted)
    return recommend.top_recommendations(recommend.recommend_actions(scored, customers, actions, as_of), top)


def simulate(invoices, payments, as_of, scenarios: int = 100, days: int = 30, seed: int = 42) -> DataFrame:
    """simulate: FC-3 -> FC-4."""
    return forecast.scenario_percentiles(forecast.cash_scenarios(invoices, payments, as_of, scenarios, days, seed))


def action(existing_actions: DataFrame, invoice_ids: DataFrame, action_type: str, when, notes: str | None = None) -> DataFrame:
    """action: AU-2 new CSV-vocabulary actions appended to the existing table (write with ``tables.append``)."""
    return audit.append_actions(existing_actions, audit.new_csv_actions(invoice_ids, action_type, when, notes))


def outreach_messages(customers, invoices, payments, as_of, action_type: str = "friendly_reminder", top: int = 10,
                      invoice_id: str | None = None, fitted=None, **company) -> DataFrame:
    """outreach: ML-6 -> OU-1 -> OU-5 (log with ``outreach.log_messages`` + ``audit.append_batch``)."""
    scored = scoring.score_invoices(invoices, customers, payments, as_of, fitted)
    targets = outreach.select_targets(scored, top, invoice_id)
    return outreach.generate_messages(targets, customers, as_of, action_type, **company)


def schedule_command(customers, invoices, payments, as_of, holidays: DataFrame | None = None,
                     max_attempts: int | None = None, fitted=None) -> tuple[DataFrame, DataFrame]:
    """schedule: ML-6 -> SC-1 for every open invoice; returns (schedule, this week's actions)."""
    scored = scoring.score_invoices(invoices, customers, payments, as_of, fitted)
    targets = scored.withColumn("days_overdue", E.days_overdue("due_date", as_of))
    s = schedule.generate_schedule(targets, as_of, holidays, max_attempts)
    return s, schedule.this_weeks_actions(s, as_of)


def track(actions, responses, outcomes, invoice_id: str | None = None, customer_id: str | None = None, start=None, end=None):
    """track: AU-3 / AU-4 / AU-7."""
    if invoice_id is not None:
        return audit.invoice_history(actions, responses, outcomes, invoice_id)
    if customer_id is not None:
        return audit.customer_history(actions, responses, outcomes, customer_id)
    return audit.audit_export(actions, responses, outcomes, start, end)


def metrics_command(actions, responses, outcomes, start=None, end=None, action_type: str | None = None):
    """metrics: AU-5 + AU-6."""
    return (
        audit.success_metrics(actions, responses, outcomes, start, end, action_type),
        audit.action_effectiveness(actions, responses, outcomes),
    )
