"""AU-8 as a stream: daily success metrics that follow the action log as it grows.

Actions and outcomes arrive as files, in any order and any micro-batch. A state per action (its date and type, whether it
was paid, and what its outcomes add up to) turns every arrival into a change of one (date, type) row; changes are appended
to a parquet table with the query's checkpoint, exactly once, also over restarts. ``current`` adds the changes up to the rows
of the batch operator ``audit.daily_success_metrics``.

The state of an action is a few numbers, however many outcomes it has, and is dropped ``keep`` after the latest event time
that it has seen (event-time timeout under a watermark of ``keep``). An outcome that comes before its action waits in the state;
one that is later than the watermark is dropped, as is one whose action never comes. A delivered action counts
once (by its id), a delivered outcome each time it is delivered.

A call of the stateful step costs milliseconds whatever it does, so actions are kept in ``shards.SHARDS`` shards by a hash of
their id: a call takes all arrivals of a shard, action by action, and adds their changes up by (date, type).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from receivables.functions import expr as E
from receivables.functions.stored import workers_find_package
from receivables.session import checkpoint_folder
from receivables.streaming import shards

ACTION_EVENTS = "action_id string, action_type string, action_date timestamp_ntz"
OUTCOME_EVENTS = "outcome_id string, action_id string, outcome_type string, outcome_date timestamp_ntz, amount_collected double, days_to_payment int"
CHANGES = "metric_date date, action_type string, actions long, successes long, cents long, days long, dated long"
EPOCH = dt.date(1970, 1, 1)


def events(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One schema for both streams: what an arrival adds to its action. Money in cents."""
    none = lambda t: F.lit(None).cast(t)
    a = actions.select(
        "action_id", F.col("action_date").cast("timestamp").alias("at"), F.unix_date(F.to_date("action_date")).alias("day"), F.col("action_type").alias("kind"),
        F.lit(True).alias("is_action"), F.lit(False).alias("paid"), F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("days"), F.lit(0).cast("long").alias("dated"),
    )
    cents = F.coalesce((F.col("amount_collected").cast("decimal(18,2)") * 100).cast("long"), F.lit(0).cast("long"))
    o = outcomes.where(F.col("action_id").isNotNull()).select(
        "action_id", F.col("outcome_date").cast("timestamp").alias("at"), none("int").alias("day"), none("string").alias("kind"), F.lit(False).alias("is_action"),
        F.coalesce(F.col("outcome_type") == "paid", F.lit(False)).alias("paid"), cents.alias("cents"),
        F.coalesce(F.col("days_to_payment").cast("long"), F.lit(0).cast("long")).alias("days"), F.col("days_to_payment").isNotNull().cast("long").alias("dated"),
    )
    return a.unionByName(o).withColumn("millis", F.unix_millis("at"))


def _plain(batch: pd.DataFrame) -> Iterator[tuple]:
    """Rows with missing values as None."""
    columns = ("action_id", "millis", "day", "kind", "is_action", "paid", "cents", "days", "dated")
    yield from zip(*([None if v is None or v != v else v for v in batch[c].tolist()] for c in columns), strict=True)


def changes(keep_ms: int):
    """The stateful step: changes of the (date, type) rows of a shard's actions."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark = shards.entries(state), state.getCurrentWatermarkMs()
        arrived: dict[str | None, list] = {}  # action -> what is known of it before, what after, its latest event
        for batch in batches:
            for action, millis, day, kind, is_action, paid, cents, days, dated in _plain(batch) if len(batch) else ():
                if action not in arrived:
                    before = json.loads(held[action][1]) if action in held else [0, None, False, False, 0, 0, 0]
                    arrived[action] = [before, list(before), watermark]
                now = arrived[action][1]
                if is_action and not now[2]:
                    now[:3] = None if day is None else int(day), kind, True
                now[3:] = now[3] or paid, now[4] + cents, now[5] + days, now[6] + dated
                arrived[action][2] = max(arrived[action][2], watermark if millis is None else int(millis))
        changed: dict[tuple, list[int]] = {}
        for action, (before, now, latest) in arrived.items():
            held[action] = latest + keep_ms + 1, json.dumps(now)
            day, kind, known, paid, *sums = now
            if known:
                # What waited for the action comes with it.
                old = before[3:] if before[2] else [False, 0, 0, 0]
                change = [int(not before[2]), int(paid) - int(old[0]), *(x - y for x, y in zip(sums, old[1:], strict=True))]
                if any(change):
                    changed[day, kind] = [x + y for x, y in zip(changed.get((day, kind), [0] * 5), change, strict=True)]
        shards.keep(state, {action: entry for action, entry in held.items() if action in arrived or entry[0] >= watermark})
        if changed:
            rows = [[None if day is None else EPOCH + dt.timedelta(days=day), kind, *change] for (day, kind), change in changed.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return step


def start(spark: SparkSession, actions_dir: str, outcomes_dir: str, sink_dir: str, keep_days: int = 400, name: str = "daily_metrics", available_now: bool = True,
          files_per_batch: int = 1000) -> StreamingQuery:
    """Run the stream into ``sink_dir`` (checkpoint under ``spark.checkpoint.dir``)."""
    workers_find_package(spark)
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    arrived = events(read(ACTION_EVENTS, actions_dir), read(OUTCOME_EVENTS, outcomes_dir)).withWatermark("at", f"{keep_days} days")
    out = arrived.withColumn("shard", shards.shard("action_id")).groupBy("shard").applyInPandasWithState(changes(keep_days * 86_400_000), CHANGES, shards.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    key = hashlib.sha1(sink_dir.encode()).hexdigest()[:12]
    place = os.path.join(checkpoint_folder(spark), "streams", f"{name}-{key}")
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", place).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.queryName(f"{name}-{key}").start()


def current(found: DataFrame) -> DataFrame:
    """The metrics after all changes so far; columns as in ``audit.daily_success_metrics``."""
    g = found.groupBy("metric_date", "action_type").agg(*[F.sum(c).alias(c) for c in ("actions", "successes", "cents", "days", "dated")])
    return g.select(
        "metric_date", "action_type", F.col("actions").alias("total_actions"), F.col("successes").alias("successful_actions"),
        (F.col("cents").cast("decimal(38,2)") / 100).cast("decimal(38,2)").cast("double").alias("total_amount_collected"),
        E.round_dec(F.try_divide(F.col("days"), F.col("dated")), 6).alias("avg_days_to_payment"),
        E.pct("successes", "actions").alias("success_rate"),
    )
