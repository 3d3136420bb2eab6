"""Rule-based invoice risk score (RS-1) and model-or-rules scoring entry point (ML-6 fallback)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.functions.joins import lookup_join
from receivables.functions.quantile import exact_quantile

# Defaults for customers missing from the customer table.
DEFAULT_TERMS_DAYS = 30
DEFAULT_CREDIT_LIMIT = 999999.0


def rule_risk_scores(invoices: DataFrame, customers: DataFrame, as_of, open_only: bool = True, sort: bool = True,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """RS-1: 0.4 overdue + 0.2 amount (vs the p95 amount) + 0.2 terms + 0.2 credit utilisation, rounded half-even.

    The p95 and the per-customer totals cover every status (D8); the open filter comes last. The p95 is an exact
    distributed quantile (one row, broadcast); customer totals are one ``groupBy`` joined back at customer grain.
    ``carry`` names further customer columns to bring along (saving a caller a second join on customer_id).
    """
    p95 = exact_quantile(invoices, "invoice_amount", 0.95, out="amount_p95")
    cust = customers.select("customer_id", "payment_terms_days", "credit_limit", *carry)
    totals = invoices.groupBy("customer_id").agg(
        F.sum(F.col("invoice_amount").cast("decimal(18,2)")).cast("double").alias("total_outstanding"),
        F.count(F.lit(1)).alias("__n"),
    )
    # Customer attributes and totals are joined to each other at customer grain first, so the only join that touches
    # invoice rows is one equi-join on customer_id; customers holding a large share of the invoices are salted
    # (the per-customer counts come with the totals, so finding them costs no extra pass).
    per_customer = totals.drop("__n").join(cust, "customer_id", "left")
    df = lookup_join(
        invoices, per_customer, "customer_id", "left", spread="invoice_id", key_counts=totals.select("customer_id", "__n")
    ).crossJoin(F.broadcast(p95))
    overdue = E.days_overdue("due_date", as_of)
    overdue_score = E.clip(overdue / 90 * 100, 0.0, 100.0)
    amount_score = F.when(F.col("amount_p95") > 0, E.clip(F.col("invoice_amount") / F.col("amount_p95") * 100, 0.0, 100.0)).otherwise(0.0)
    terms = F.coalesce(F.col("payment_terms_days"), F.lit(DEFAULT_TERMS_DAYS))
    terms_score = E.clip(terms / 60 * 100, 0.0, 100.0)
    limit = F.coalesce(F.col("credit_limit"), F.lit(DEFAULT_CREDIT_LIMIT))
    tot = F.col("total_outstanding")
    # Zero limit: x/0 is +inf -> 100 (or -inf -> 0); 0/0 is NaN in the reference and crashes there: 0 here.
    util = (
        F.when(limit != 0, E.clip(tot / limit * 100, 0.0, 100.0))
        .when(tot > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    score = overdue_score * 0.40 + amount_score * 0.20 + terms_score * 0.20 + util * 0.20
    out = df.withColumn("risk_score", F.bround(score, 0).cast("int")).withColumn(
        "risk_category", E.risk_category("risk_score")
    )
    if open_only:
        out = out.where(F.col("status") == "open")
    out = out.select(
        "invoice_id", "customer_id", "issue_date", "due_date", "invoice_amount", "currency", "status",
        "risk_score", "risk_category", *carry,
    )
    # Callers that feed the scores into further joins pass sort=False: a global sort there would be wasted work.
    return out.orderBy(F.desc("risk_score"), "invoice_id") if sort else out


def score_invoices(invoices: DataFrame, customers: DataFrame, payments: DataFrame | None, as_of, model=None) -> DataFrame:
    """ML-6: score open invoices with a fitted model when given, else with the rule score."""
    if model is None:
        return rule_risk_scores(invoices, customers, as_of)
    from receivables.operators import model as M

    return M.score_open_invoices(model, invoices, customers, payments, as_of)
