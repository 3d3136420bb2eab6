"""Column-expression helpers (FN-*): everything here is a pure Catalyst expression.

Nothing in this module touches data; each helper returns a ``Column`` that stays inside
whole-stage codegen when used in a projection, filter or aggregate.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aging bucket labels and their order (library 6-bucket set, dashboard 5-bucket set).
AGING_BUCKETS = ["current", "1-15", "16-30", "31-60", "61-90", "90+"]
DASH_BUCKETS = ["Current", "1-30 days", "31-60 days", "61-90 days", "90+ days"]
# Risk categories, lowest first.
RISK_CATEGORIES = ["low", "medium", "high", "very_high"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of) -> Column:
    """A DATE (or TIMESTAMP_NTZ when a datetime is given) literal for the evaluation date."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of).cast("timestamp_ntz")
    if isinstance(as_of, str):
        return F.to_date(F.lit(as_of))
    return F.lit(as_of)


def days_floor(end, start) -> Column:
    """Whole days from ``start`` to ``end``, floored (pandas ``timedelta.days``).

    DATE inputs reduce to ``datediff``; timestamps use the microsecond difference floored to days,
    so -0.75 days is -1 as in pandas (``timestampdiff`` would truncate toward zero).
    """
    e, s = col(end), col(start)
    micros = F.unix_micros(e.cast("timestamp")) - F.unix_micros(s.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def days_between(start, end) -> Column:
    """Signed whole days between two DATE columns."""
    return F.datediff(col(end), col(start))


def days_overdue(due, as_of) -> Column:
    """max(0, as_of - due) in days; NULL due gives 0."""
    return F.coalesce(F.greatest(F.lit(0), F.datediff(as_of_lit(as_of), col(due))), F.lit(0))


def days_late(paid, due) -> Column:
    """Days from the due date to the payment, at least 0; NULL when either date is (``greatest`` would make that 0)."""
    late = F.datediff(col(paid), col(due))
    return F.when(late.isNotNull(), F.greatest(F.lit(0), late))


def days_until_due(due, as_of) -> Column:
    return F.datediff(col(due), as_of_lit(as_of))


def aging_bucket(days) -> Column:
    """Six-bucket aging label (FN-2)."""
    d = col(days)
    return (
        F.when(d <= 0, "current")
        .when(d <= 15, "1-15")
        .when(d <= 30, "16-30")
        .when(d <= 60, "31-60")
        .when(d <= 90, "61-90")
        .otherwise("90+")
    )


def aging_bucket_order(bucket) -> Column:
    b = col(bucket)
    out = F.when(b == AGING_BUCKETS[0], 0)
    for i, name in enumerate(AGING_BUCKETS[1:], start=1):
        out = out.when(b == name, i)
    return out


def dash_aging_bucket(days) -> Column:
    """Five-bucket dashboard label (FN-3)."""
    d = col(days)
    return (
        F.when(d <= 0, "Current")
        .when(d <= 30, "1-30 days")
        .when(d <= 60, "31-60 days")
        .when(d <= 90, "61-90 days")
        .otherwise("90+ days")
    )


def risk_category(score) -> Column:
    """FN-4: >=86 very_high, >=61 high, >=31 medium, else low."""
    s = col(score)
    return F.when(s >= 86, "very_high").when(s >= 61, "high").when(s >= 31, "medium").otherwise("low")


def amount_bucket(amount) -> Column:
    """FN-10: right-closed amount bands; <=0 (and NULL) gives NULL."""
    a = col(amount)
    return (
        F.when(a <= 0, F.lit(None).cast("string"))
        .when(a <= 1000, "tiny")
        .when(a <= 5000, "small")
        .when(a <= 10000, "medium")
        .when(a <= 50000, "large")
        .when(a > 50000, "xlarge")
    )


def clip(c, lo=None, hi=None) -> Column:
    out = col(c)
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return out


def money2(c) -> Column:
    """Round to 2 decimals through DECIMAL so both engines agree on ties."""
    return F.round(col(c).cast("decimal(28,6)"), 2).cast("double")


def round_dec(c, scale: int) -> Column:
    return F.round(col(c).cast("decimal(28,6)"), scale).cast("double")


def money_sum(c) -> Column:
    """Exact sum of 2-decimal money values (order-independent), returned as DOUBLE."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def pct(num, den, scale: int = 2) -> Column:
    """num / den * 100 rounded; NULL when den is 0 or NULL (ANSI-safe)."""
    return round_dec(F.try_divide(col(num), col(den)) * 100, scale)


def compact_currency(c) -> Column:
    """FN-11: $x.xxM / $x.xK / $x.xx; NULL -> $0."""
    v = col(c)
    return (
        F.when(v.isNull(), "$0")
        .when(F.abs(v) >= 1_000_000, F.format_string("$%.2fM", v / 1_000_000))
        .when(F.abs(v) >= 1_000, F.format_string("$%.1fK", v / 1_000))
        .otherwise(F.format_string("$%.2f", v))
    )


def business_days(start, end) -> Column:
    """FN-8: weekdays in [start, end] inclusive, 0 when start > end.

    Closed form: 5 per whole week plus the weekdays among the <= 6 remaining days.
    """
    s, e = col(start), col(end)
    n = F.datediff(e, s) + 1
    full = F.floor(n / 7).cast("int")
    rem = (n - full * 7).cast("int")
    first_rest = F.date_add(s, full * 7)
    tail = F.aggregate(
        F.sequence(F.lit(0), F.greatest(rem - 1, F.lit(0))),
        F.lit(0),
        lambda acc, i: acc + F.when((rem > 0) & (F.weekday(F.date_add(first_rest, i)) < 5), 1).otherwise(0),
    )
    return F.when(s > e, F.lit(0)).otherwise(full * 5 + tail)


def week_start(d) -> Column:
    """Monday of the week (FN-5)."""
    return F.date_sub(col(d), F.weekday(col(d)))
