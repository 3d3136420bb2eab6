"""Success metrics over any date range from one small row per day and type (AU-5): mergeable exact distinct counts.

Every action gets a dense number, ordered by the day it first appears. Per (day, type, bucket of 32,768 numbers) the table
holds bitmaps of the actions sent, of those paid and of those answered, and per (day, type) the weighted sums behind the means
and amounts. A range of days is answered from those rows alone: bitmaps are merged with ``bitmap_or_agg`` and counted, so an
action that stands on several days counts once, and no range reads the log again. As numbers follow days, the
bitmaps of a day touch few buckets.

Numbers come from counts: rows per day, then per hash bucket of a day, each with its prefix sum (one row per calendar day and
bucket), and a rank inside a bucket, which holds about ``RANKED`` rows at most however many fall on one day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators.audit import _action_grain

RANKED = 500_000


def numbered_actions(actions: DataFrame, buckets: int) -> DataFrame:
    """(action_id, number): dense from 0, by the first day of the action, then a hash of its id."""
    first = actions.groupBy("action_id").agg(F.min(F.to_date("action_date")).alias("day"))
    first = first.withColumn("bucket", F.pmod(F.xxhash64("action_id"), F.lit(buckets)))
    cells = first.groupBy("day", "bucket").agg(F.count(F.lit(1)).alias("n"))
    days = cells.groupBy("day").agg(F.sum("n").alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("day", ahead(Window.orderBy(F.col("day").asc_nulls_first())).alias("days_before"))
    cells = cells.select("day", "bucket", ahead(Window.partitionBy("day").orderBy("bucket")).alias("cells_before"))
    starts = cells.alias("c").join(F.broadcast(days.alias("d")), F.col("c.day").eqNullSafe(F.col("d.day")))  # a row per calendar day
    starts = starts.select(F.col("c.day").alias("d"), F.col("c.bucket").alias("b"), (F.col("days_before") + F.col("cells_before")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("day", "bucket").orderBy(F.xxhash64("action_id"), "action_id"))
    ranked = first.withColumn("rank", rank)
    met = ranked.join(starts, F.col("day").eqNullSafe(F.col("d")) & (F.col("bucket") == F.col("b")))
    return met.select("action_id", (F.col("before") + F.col("rank") - 1).alias("number"))


def activity_days(actions: DataFrame, responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """day, action_type, bucket, sent, paid, answered (bitmaps), wd, wn, wa (weighted sums, on the rows of their bucket)."""
    buckets = max(1, -(-actions.count() // RANKED))
    rows = _action_grain(actions, responses, outcomes).join(numbered_actions(actions, buckets), "action_id")
    bit, number = F.bitmap_bit_position("number"), F.col("number")
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.bitmap_bit_position("number"))
    return rows.groupBy(F.to_date("action_date").alias("day"), "action_type", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(bit).alias("sent"),
        F.bitmap_construct_agg(flag("n_paid_out")).alias("paid"),
        F.bitmap_construct_agg(flag("n_resp")).alias("answered"),
        F.sum(F.col("w") * F.col("sum_days")).alias("wd"), F.sum(F.col("w") * F.col("n_days")).alias("wn"), F.sum(F.col("w") * F.col("sum_amt")).alias("wa"),
    )


def range_metrics(days: DataFrame, ranges: DataFrame) -> DataFrame:
    """``success_metrics`` of every row of ``ranges`` (range_id, first_day, last_day, kind; NULL for no limit), from
    ``activity_days``. ``ranges`` is a small list."""
    r = F.broadcast(ranges)
    inside = (
        (F.col("first_day").isNull() | (F.col("day") >= F.col("first_day"))) & (F.col("last_day").isNull() | (F.col("day") <= F.col("last_day")))
        & (F.col("kind").isNull() | (F.col("action_type") == F.col("kind")))
    )
    met = days.join(r, inside)
    merged = met.groupBy("range_id", "bucket").agg(
        *[F.bitmap_count(F.bitmap_or_agg(c)).alias(c) for c in ("sent", "paid", "answered")], *[F.sum(c).alias(c) for c in ("wd", "wn", "wa")]
    )
    total = merged.groupBy("range_id").agg(*[F.sum(c).alias(c) for c in ("sent", "paid", "answered", "wd", "wn", "wa")])
    whole = ranges.select("range_id").join(total, "range_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    share = lambda c: F.coalesce(E.round_dec(F.try_divide(F.col(c), F.col("sent")), 6), F.lit(0.0))
    return whole.select(
        "range_id", n("sent").alias("total_actions"), n("paid").alias("successful_actions"), share("paid").alias("success_rate"), share("answered").alias("response_rate"),
        F.coalesce(E.round_dec(F.try_divide(F.col("wd"), F.col("wn")), 6), F.lit(0.0)).alias("avg_days_to_payment"),
        F.coalesce(F.col("wa"), F.lit(0)).cast("double").alias("total_amount_collected"),
    )
