"""Golden micro-tables for the scalar expressions (FN-*)."""

import datetime as dt

from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.functions.dates import parse_date


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_aging_bucket_edges(spark):
    days = [0, 1, 15, 16, 30, 31, 60, 61, 90, 91, -5]
    got = one(spark, [(d,) for d in days], "d int", E.aging_bucket("d"))
    assert got == ["current", "1-15", "1-15", "16-30", "16-30", "31-60", "31-60", "61-90", "61-90", "90+", "current"]


def test_dash_bucket_edges(spark):
    got = one(spark, [(d,) for d in [0, 1, 30, 31, 60, 61, 90, 91]], "d int", E.dash_aging_bucket("d"))
    assert got == ["Current", "1-30 days", "1-30 days", "31-60 days", "31-60 days", "61-90 days", "61-90 days", "90+ days"]


def test_risk_category_edges(spark):
    got = one(spark, [(s,) for s in [30, 31, 60, 61, 85, 86]], "s int", E.risk_category("s"))
    assert got == ["low", "medium", "medium", "high", "high", "very_high"]


def test_amount_bucket_edges(spark):
    got = one(spark, [(a,) for a in [0.0, 1000.0, 1000.01, 5000.0, 10000.0, 50000.0, 50000.01, -3.0]], "a double",
              E.amount_bucket("a"))
    assert got == [None, "tiny", "small", "small", "medium", "large", "xlarge", None]


def test_days_overdue_null_due_is_zero(spark):
    got = one(spark, [(None,), (dt.date(2001, 6, 1),), (dt.date(2001, 7, 1),)], "d date",
              E.days_overdue("d", dt.date(2001, 6, 30)))
    assert got == [0, 29, 0]


def test_days_floor_matches_pandas_floor(spark):
    rows = [(dt.datetime(2001, 1, 1, 18), dt.datetime(2001, 1, 1, 0))]
    got = one(spark, rows, "a timestamp_ntz, b timestamp_ntz", E.days_floor("b", "a"))
    assert got == [-1]  # -0.75 days floors to -1 like timedelta.days


def test_business_days(spark):
    pairs = [
        (dt.date(2001, 7, 2), dt.date(2001, 7, 6)),   # Mon..Fri -> 5
        (dt.date(2001, 7, 2), dt.date(2001, 7, 8)),   # Mon..Sun -> 5
        (dt.date(2001, 7, 6), dt.date(2001, 7, 9)),   # Fri..Mon -> 2
        (dt.date(2001, 7, 7), dt.date(2001, 7, 8)),   # Sat..Sun -> 0
        (dt.date(2001, 7, 9), dt.date(2001, 7, 2)),   # start > end -> 0
        (dt.date(2001, 1, 1), dt.date(2001, 12, 31)),  # a year -> 261
    ]
    got = one(spark, pairs, "s date, e date", E.business_days("s", "e"))
    assert got == [5, 5, 2, 0, 0, 261]


def test_compact_currency(spark):
    vals = [None, 1_500_000.0, 2_500.0, 999.5, -2_000.0]
    got = one(spark, [(v,) for v in vals], "v double", E.compact_currency("v"))
    assert got == ["$0", "$1.50M", "$2.5K", "$999.50", "$-2.0K"]


def test_week_and_month_bounds(spark):
    df = spark.createDataFrame([(dt.date(2001, 7, 4),)], "d date")
    r = df.select(E.week_start("d").alias("ws"), F.last_day("d").alias("me"), F.trunc("d", "MM").alias("ms")).first()
    assert (r.ws, r.me, r.ms) == (dt.date(2001, 7, 2), dt.date(2001, 7, 31), dt.date(2001, 7, 1))


def test_parse_date_formats(spark):
    raw = ["2001-06-05", "2001/06/05", "05-06-2001", "05/06/2001", "2001-06-05 10:20:30", "2001-06-05T10:20:30",
           "not a date", "2001-02-30", "2001-06-05 junk"]
    got = one(spark, [(r,) for r in raw], "r string", parse_date("r"))
    d = dt.datetime(2001, 6, 5)
    assert got == [d, d, d, d, dt.datetime(2001, 6, 5, 10, 20, 30), dt.datetime(2001, 6, 5, 10, 20, 30), None, None, None]


def test_money_rounding_is_half_up_through_decimal(spark):
    got = one(spark, [(1.005,), (2.675,), (0.125,)], "v double", E.money2("v"))
    assert got == [1.01, 2.68, 0.13]
