"""Property checks of Spark expressions against small brute-force Python versions."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from receivables.functions import expr as E
from receivables.operators import recommend

BASE = dt.date(2001, 1, 1)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 800), st.integers(-20, 800)), min_size=1, max_size=40))
def test_business_days_match_numpy(spark, pairs):
    rows = [(BASE + dt.timedelta(days=a), BASE + dt.timedelta(days=a + b)) for a, b in pairs]
    got = [r[0] for r in spark.createDataFrame(rows, "s date, e date").select(E.business_days("s", "e")).collect()]
    exp = [0 if s > e else int(np.busday_count(s, e + dt.timedelta(days=1))) for s, e in rows]
    assert got == exp


def ladder(d, r, p, hv):
    """Plain-Python statement of the recommendation ladder, used as the brute-force check."""
    if p >= 5:
        return "escalate"
    if d <= 0 and r >= 70:
        return "friendly_reminder"
    if 0 < d <= 3:
        return "friendly_reminder" if p == 0 else "second_reminder"
    if 4 <= d <= 10:
        return "reminder_with_inquiry" if p == 0 else "call"
    if 11 <= d <= 20:
        return "call" if hv else "firm_reminder"
    if 21 <= d <= 45:
        return "payment_plan_offer" if p < 2 else "pause_service_warning"
    return "escalate" if hv else "final_notice"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 100), st.integers(0, 7), st.booleans()), min_size=1, max_size=50))
def test_action_ladder_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "d int, r int, p int, hv boolean")
    got = [x[0] for x in df.select(recommend.determine_action("d", "r", "p", "hv")).collect()]
    assert got == [ladder(*row) for row in rows]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-10, 400), min_size=1, max_size=50))
def test_aging_bucket_matches_brute_force(spark, days):
    def bucket(d):
        for hi, name in [(0, "current"), (15, "1-15"), (30, "16-30"), (60, "31-60"), (90, "61-90")]:
            if d <= hi:
                return name
        return "90+"

    got = [x[0] for x in spark.createDataFrame([(d,) for d in days], "d int").select(E.aging_bucket("d")).collect()]
    assert got == [bucket(d) for d in days]
