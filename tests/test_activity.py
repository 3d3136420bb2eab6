"""Success metrics from bitmaps of days, and the daily metrics stream."""

import datetime as dt
import random

import pytest

from receivables.operators import activity, audit
from receivables.sources import tables
from receivables.streaming import daily_metrics, shards

T = dt.datetime(2024, 1, 1)
KINDS = ["call", "email", "escalate"]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    actions = [(f"A{i}", rng.choice(KINDS), T + dt.timedelta(hours=rng.randrange(24 * 12))) for i in range(150)]
    responses = [(f"R{i}", f"A{rng.randrange(170)}") for i in range(120)]
    outcomes = [(f"O{i}", rng.choice([f"A{rng.randrange(170)}", None]), rng.choice(["paid", "partial"]), T + dt.timedelta(days=rng.randrange(30)), rng.choice([None, round(rng.random() * 99, 2)]), rng.choice([None, rng.randrange(40)]))
                for i in range(160)]
    a = spark.createDataFrame(actions, daily_metrics.ACTION_EVENTS)
    r = spark.createDataFrame(responses, "response_id string, action_id string")
    o = spark.createDataFrame(outcomes, daily_metrics.OUTCOME_EVENTS)
    return a, r, o


def test_numbers_are_dense_and_follow_days(spark, log, monkeypatch):
    a, _, _ = log
    for buckets in (1, 7):
        rows = activity.numbered_actions(a.unionByName(a.limit(20)), buckets).join(a, "action_id").collect()
        assert sorted({r.number for r in rows}) == list(range(150))
        days = [r.action_date.date() for r in sorted(rows, key=lambda r: r.number)]
        assert days == sorted(days)


def test_ranges_equal_the_metrics_of_each_range(spark, log, monkeypatch):
    a, r, o = log
    monkeypatch.setattr(activity, "RANKED", 40)
    day = lambda n: None if n is None else (T + dt.timedelta(days=n)).date()
    asked = [(0, None, None, None), (1, 0, 0, None), (2, 3, 9, None), (3, None, 5, "call"), (4, 4, None, "email"), (5, 20, 30, None), (6, 2, 8, "none")]
    ranges = spark.createDataFrame([(i, day(x), day(y), k) for i, x, y, k in asked], "range_id int, first_day date, last_day date, kind string")
    days = activity.activity_days(a, r, o)
    got = {x.range_id: tuple(x)[1:] for x in activity.range_metrics(days, ranges).collect()}
    for i, x, y, k in asked:
        start = None if x is None else T + dt.timedelta(days=x)
        end = None if y is None else T + dt.timedelta(days=y, hours=23, minutes=59)
        assert got[i] == tuple(audit.success_metrics(a, r, o, start, end, k).first()), i
    assert days.count() <= 13 * len(KINDS)


def test_an_action_on_several_days_counts_once(spark):
    a = spark.createDataFrame([("A", "call", T), ("A", "call", T + dt.timedelta(days=3)), ("B", "call", T)], daily_metrics.ACTION_EVENTS)
    r = spark.createDataFrame([("R", "A")], "response_id string, action_id string")
    o = spark.createDataFrame([("O", "A", "paid", T, 5.0, 2)], daily_metrics.OUTCOME_EVENTS)
    ranges = spark.createDataFrame([(0, None, None, None), (1, (T + dt.timedelta(days=1)).date(), None, None)], "range_id int, first_day date, last_day date, kind string")
    got = {x.range_id: x for x in activity.range_metrics(activity.activity_days(a, r, o), ranges).collect()}
    assert (got[0].total_actions, got[0].successful_actions, got[0].response_rate) == (2, 1, 0.5)
    assert (got[1].total_actions, got[1].successful_actions) == (1, 1)


def put(df, folder):
    tables.save(df.coalesce(1), folder, mode="append")


def run(spark, folder, **more):
    daily_metrics.start(spark, f"{folder}/actions", f"{folder}/outcomes", f"{folder}/changes", **more).awaitTermination()
    return spark.read.schema(daily_metrics.CHANGES).parquet(f"{folder}/changes")


def test_stream_in_any_order_and_over_restarts(spark, log, scratch):
    a, _, o = log
    outcome_columns = o.columns
    parts = 3
    for n in range(parts):  # outcomes of other actions than those that arrive with them
        put(o.where(f"pmod(crc32(outcome_id), {parts}) = {parts - 1 - n}").select(*outcome_columns), f"{scratch}/outcomes")
        put(a.where(f"pmod(crc32(action_id), {parts}) = {n}"), f"{scratch}/actions")
        found = run(spark, scratch, files_per_batch=1)
    want = sorted(map(tuple, audit.daily_success_metrics(a, o).collect()))
    assert sorted(map(tuple, daily_metrics.current(found).collect())) == want
    before = found.count()
    assert run(spark, scratch).count() == before  # nothing new arrived: nothing is repeated
    put(a.limit(10), f"{scratch}/actions")  # delivered again
    assert sorted(map(tuple, daily_metrics.current(run(spark, scratch)).collect())) == want


def test_late_events_beyond_the_watermark_are_dropped(spark, scratch):
    one = lambda i, n: spark.createDataFrame([(i, "call", T + dt.timedelta(days=n))], daily_metrics.ACTION_EVENTS)
    paid = lambda i, n: spark.createDataFrame([("O" + i, i, "paid", T + dt.timedelta(days=n), 1.0, 1)], daily_metrics.OUTCOME_EVENTS)
    put(one("A", 0), f"{scratch}/actions")
    put(paid("A", 4), f"{scratch}/outcomes")
    run(spark, scratch, keep_days=10)
    put(one("B", 40), f"{scratch}/actions")
    run(spark, scratch, keep_days=10)
    put(one("C", 1), f"{scratch}/actions")  # older than the watermark (day 30)
    put(paid("B", 45), f"{scratch}/outcomes")
    rows = {r.metric_date: r for r in daily_metrics.current(run(spark, scratch, keep_days=10)).collect()}
    assert set(rows) == {T.date(), (T + dt.timedelta(days=40)).date()} and all(r.successful_actions == r.total_actions == 1 for r in rows.values())


def test_calls_do_not_grow_with_the_actions(spark, log, scratch, monkeypatch):
    """Many actions share a call of the stateful step and its changes."""
    monkeypatch.setattr(shards, "SHARDS", 2)
    a, _, o = log
    put(a, f"{scratch}/actions")
    put(o, f"{scratch}/outcomes")
    found = run(spark, scratch)
    assert sorted(map(tuple, daily_metrics.current(found).collect())) == sorted(map(tuple, audit.daily_success_metrics(a, o).collect()))
    assert found.count() <= 2 * a.selectExpr("to_date(action_date)", "action_type").distinct().count()
