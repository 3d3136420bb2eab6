"""Skew-safe join of a fact table to a one-row-per-key table.

AQE's skew-join split only applies when both join inputs are plain shuffle stages; a per-customer table that is
itself an aggregate or a join is not, so a customer holding a large share of the invoices would put all of them in
one task. ``lookup_join`` splits such hot keys explicitly:

* a key is hot when it holds more than ``hot_share`` of the fact rows and more rows than a task should get, so there
  are at most ``1 / hot_share`` hot keys -- a proven bound, which is what makes broadcasting the hot-key set safe;
* a hot key gets ``ceil(its rows / rows_per_task)`` buckets: its fact rows are dealt over them by a hash of ``spread``,
  its single dimension row is replicated to each; all other keys keep salt 0 and are not replicated;
* rows with a NULL key match nothing, so each is salted by its own hash and they spread over all partitions;
* the join runs on (key, salt).

Results are identical to a plain join (each fact row still meets exactly the rows of its key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
ROWS_PER_TASK = 200_000


def hot_keys(key_counts: DataFrame, key: str, count_col: str, hot_share: float = HOT_SHARE,
             rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, __buckets) of the keys with more than ``hot_share`` of all rows (at most ``1 / hot_share`` keys) that fill
    more than one task."""
    total = key_counts.agg(F.sum(count_col).alias("__total"))
    n = F.col(count_col)
    return (
        key_counts.crossJoin(F.broadcast(total))
        .where((n > F.col("__total") * hot_share) & (n > rows_per_task) & F.col(key).isNotNull())
        .select(key, F.ceil(n / rows_per_task).cast("int").alias("__buckets"))
    )


def lookup_join(
    fact: DataFrame, dim: DataFrame, key: str, how: str = "left", *, spread: str | list[str],
    key_counts: DataFrame | None = None, count_col: str = "__n", hot_share: float = HOT_SHARE,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``fact.join(dim, key, how)`` for a ``dim`` with one row per key, with hot and NULL keys salted.

    ``spread`` names fact columns that vary within a key (e.g. invoice_id): their hash deals rows the same way when a lost task
    runs again. ``key_counts`` (key, count_col) may be passed when the caller already has fact rows per key, saving the
    counting pass.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join supports left and inner joins")
    if key_counts is None:
        key_counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
    hot = F.broadcast(hot_keys(key_counts.select(key, count_col), key, count_col, hot_share, rows_per_task))
    spread_hash = F.xxhash64(*([spread] if isinstance(spread, str) else spread))
    salt = F.when(F.col(key).isNull(), spread_hash).when(F.col("__buckets").isNotNull(), F.pmod(spread_hash, "__buckets"))
    f = fact.join(hot, key, "left").withColumn("__salt", F.coalesce(salt, F.lit(0).cast("long"))).drop("__buckets")
    d = dim.join(hot, key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__buckets", F.lit(1)).cast("long") - 1))
    ).drop("__buckets")
    return f.join(d, [key, "__salt"], how).drop("__salt")
