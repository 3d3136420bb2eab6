"""Imports every registration module so the catalog is complete."""

from receivables.plans import reg_aging  # noqa: F401
from receivables.plans import reg_metrics  # noqa: F401
from receivables.plans import reg_plan  # noqa: F401
from receivables.plans import reg_audit  # noqa: F401
from receivables.plans import reg_data  # noqa: F401
from receivables.plans import reg_model  # noqa: F401
from receivables.plans import reg_history  # noqa: F401
from receivables.plans import reg_outreach  # noqa: F401
from receivables.plans import reg_io  # noqa: F401  (over the queries above)
from receivables.plans import reg_nulls  # noqa: F401  (over the queries above)
