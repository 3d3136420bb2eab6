"""The NULL rules: queries over fixture views with NULL dates, statuses and customer ids.

A date that is unknown on either side is not zero days late: it stays out of means, and is not late. Groups have no NULL
key. The oracles are those of the plain queries over the other views.
"""

from __future__ import annotations

from receivables.plans.catalog import register_over

NULLS = {"invoices": "invoices_nulls", "payments": "payments_nulls"}

for _name in (
    "customer_risk", "payment_behavior", "customer_aging", "monthly_payments", "top_customers_ar", "status_distribution",
    "customer_summary", "invoice_timeline", "ar_concentration", "late_target", "customer_history", "dash_kpis",
):
    register_over(f"{_name}_nulls", _name, NULLS)
