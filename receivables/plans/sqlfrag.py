"""Small SQL text fragments shared by the DuckDB oracle strings (kept next to the catalog that uses them)."""

from __future__ import annotations


def bucket6(d: str) -> str:
    return (
        f"CASE WHEN {d} <= 0 THEN 'current' WHEN {d} <= 15 THEN '1-15' WHEN {d} <= 30 THEN '16-30' "
        f"WHEN {d} <= 60 THEN '31-60' WHEN {d} <= 90 THEN '61-90' ELSE '90+' END"
    )


def bucket5(d: str) -> str:
    return (
        f"CASE WHEN {d} <= 0 THEN 'Current' WHEN {d} <= 30 THEN '1-30 days' WHEN {d} <= 60 THEN '31-60 days' "
        f"WHEN {d} <= 90 THEN '61-90 days' ELSE '90+ days' END"
    )


def overdue(due: str, as_of: str) -> str:
    return f"CAST(coalesce(greatest(0, date_diff('day', {due}, {as_of})), 0) AS int)"


def money2(x: str) -> str:
    return f"CAST(round(CAST({x} AS decimal(28,6)), 2) AS double)"


def round_dec(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS decimal(28,6)), {n}) AS double)"


def msum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS decimal(18,2))) AS double)"


def pct(num: str, den: str, n: int = 2) -> str:
    return round_dec(f"(CAST({num} AS double) / NULLIF(CAST({den} AS double), 0)) * 100", n)


def risk_cat(s: str) -> str:
    return f"CASE WHEN {s} >= 86 THEN 'very_high' WHEN {s} >= 61 THEN 'high' WHEN {s} >= 31 THEN 'medium' ELSE 'low' END"


def days_late(paid: str, due: str) -> str:
    """Days late, at least 0; NULL when a date is unknown."""
    return f"CASE WHEN {paid} IS NOT NULL AND {due} IS NOT NULL THEN greatest(0, date_diff('day', {due}, {paid})) END"
