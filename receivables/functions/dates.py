"""Multi-format date parsing (DQ-14) as one Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from receivables.functions.expr import col

# Accepted input formats, tried in this order (first match wins). Python strptime spelling:
# %Y-%m-%d, %Y/%m/%d, %d-%m-%Y, %d/%m/%Y, %Y-%m-%d %H:%M:%S, %Y-%m-%dT%H:%M:%S. Spark datetime-pattern spelling:
DATE_FORMATS = [
    "yyyy-M-d",
    "yyyy/M/d",
    "d-M-yyyy",
    "d/M/yyyy",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
]


def parse_date(c) -> Column:
    """First format that parses the whole string wins; anything else is NULL (a reject)."""
    s = col(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS]).cast("timestamp_ntz")
