"""Audit log (AU-*): append batches, history views and success metrics over actions / responses / outcomes.

Metrics (AU-5, AU-6, AU-8) reduce responses and outcomes to one row per action *before* they meet the action table, so
these joins run at action grain. The reference's sums and averages run over the product of an action's responses and
outcomes (D13); the per-action weights below (``max(1, responses)``) give exactly those numbers without building it.

Histories (AU-3, AU-4, AU-7) do list that product: an action with r responses and o outcomes has max(1, r) * max(1, o)
rows, as many as one action's own records make. Outcomes that name no known action are listed once, without an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from receivables.functions import expr as E
from receivables.functions.joins import lookup_join
from receivables.session import checkpoint_folder

ACTION_COLUMNS = [
    "action_id", "invoice_id", "customer_id", "action_type", "action_date", "scheduled_date", "channel",
    "message_sent", "sent_by", "notes", "created_at",
]


def _table_schema(spark: SparkSession, path: str) -> StructType | None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path).schema if fs.exists(jpath) else None


BATCH = "batch_id"


def append_batch(batch: DataFrame, path: str, id_col: str = "action_id", partition_by: str | None = "action_month",
                 date_col: str = "action_date", batch_id: str | None = None) -> DataFrame:
    """AU-1: append a batch of actions, responses or outcomes to a parquet audit table and return it with its ids.

    With a ``batch_id`` the append happens exactly once: the batch is a partition of the table (above the month), written by
    dynamic overwrite, so a batch that is sent again after a failure, or by mistake, replaces itself. Rows without an id get one
    that follows from the batch, the row and its number among equal rows, hence the same one each time. A table is kept
    either with batch ids or without.

    Without a ``batch_id`` every call appends, and ids are whole uuids; the batch is then written to the shared checkpoint
    folder first, so that a retried task cannot give a row another id than the one returned.

    Columns and types must be those of the table, if there is one; otherwise nothing is written. Rows are stamped, and
    partitioned by month for pruning.
    """
    spark = batch.sparkSession
    given = F.col(id_col).cast("string") if id_col in batch.columns else F.lit(None).cast("string")
    out = batch.withColumn(id_col, given)
    if batch_id is None:
        out = out.withColumn(id_col, F.coalesce(id_col, F.expr("uuid()")))
    else:
        # Equal rows are counted first, so that their numbers need no window however many they are.
        columns = out.columns
        counted = out.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
        numbered = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
        own = F.md5(F.to_json(F.struct(F.lit(batch_id).alias("b"), F.struct(*columns).alias("r"), F.col("__copy").alias("n"))))
        out = numbered.withColumn(id_col, F.coalesce(id_col, own)).select(*columns)
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.localtimestamp())
    parts = []
    if batch_id is not None:
        out = out.withColumn(BATCH, F.lit(batch_id))
        parts.append(BATCH)
    if partition_by:
        out = out.withColumn(partition_by, F.date_format(F.col(date_col), "yyyy-MM"))
        parts.append(partition_by)
    found = _table_schema(spark, path)
    if found is not None:
        if (BATCH in found.names) != (batch_id is not None):
            raise ValueError(f"the audit table {path} is kept {'with' if BATCH in found.names else 'without'} batch ids")
        there = {f.name: f.dataType.simpleString() for f in found if f.name not in parts}
        new = {f.name: f.dataType.simpleString() for f in out.schema if f.name not in parts}
        if there != new:
            differ = sorted(k for k in there.keys() | new.keys() if there.get(k) != new.get(k))
            raise ValueError(f"batch does not fit the audit table {path}: {[(k, there.get(k), new.get(k)) for k in differ]}")
    if batch_id is None:
        checkpoint_folder(spark)
        out = out.checkpoint()
        writer = out.write.mode("append")
    else:
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    if batch_id is not None:
        out = spark.read.parquet(path).where(F.col(BATCH) == batch_id)
    return out.drop(*parts)


def new_csv_actions(invoice_ids: DataFrame, action_type: str, action_date, notes: str | None = None) -> DataFrame:
    """AU-2: build CSV-vocabulary action rows with outcome pending. The key is ``ACT-`` and a whole uuid; ``short_id``
    (``ACT-`` and 8 hex digits) is for display, as it is not unique."""
    return invoice_ids.select(
        F.concat(F.lit("ACT-"), F.upper(F.regexp_replace(F.expr("uuid()"), "-", ""))).alias("action_id"),
        "invoice_id",
        F.lit(action_type).alias("action_type"),
        E.as_of_lit(action_date).cast("timestamp_ntz").alias("action_date"),
        F.lit(notes).cast("string").alias("notes"),
        F.lit("pending").alias("outcome"),
    ).withColumn("short_id", F.substring("action_id", 1, 12))


def append_actions(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """AU-2 / SNK-2: existing actions plus the new batch (set-based, by column name)."""
    return existing.unionByName(new_rows, allowMissingColumns=True)


def _outcomes_per_action(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("action_id").agg(
        F.count("outcome_id").alias("n_out"),
        F.count_if(F.col("outcome_type") == "paid").alias("n_paid_out"),
        F.sum(F.col("days_to_payment")).alias("sum_days"),
        F.count("days_to_payment").alias("n_days"),
        F.sum(F.col("amount_collected").cast("decimal(18,2)")).alias("sum_amt"),
        F.count("amount_collected").alias("n_amt"),
    )


def _responses_per_action(responses: DataFrame) -> DataFrame:
    return responses.groupBy("action_id").agg(F.count("response_id").alias("n_resp"))


def _action_grain(actions: DataFrame, responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    a = actions.join(_responses_per_action(responses), "action_id", "left").join(
        _outcomes_per_action(outcomes), "action_id", "left"
    )
    # Weight = number of rows the reference's left joins would produce per outcome row of this action.
    return a.withColumn("w", F.greatest(F.lit(1), F.coalesce(F.col("n_resp"), F.lit(0))))


def _filter_dates(rows: DataFrame, start=None, end=None, action_type: str | None = None, date_col: str = "action_date") -> DataFrame:
    if start is not None:
        rows = rows.where(F.col(date_col) >= E.as_of_lit(start))
    if end is not None:
        rows = rows.where(F.col(date_col) <= E.as_of_lit(end))
    if action_type is not None:
        rows = rows.where(F.col("action_type") == action_type)
    return rows


def success_metrics(actions: DataFrame, responses: DataFrame, outcomes: DataFrame, start=None, end=None,
                    action_type: str | None = None) -> DataFrame:
    """AU-5: distinct totals, success and response rates, mean days to payment and amount collected (one row)."""
    a = _action_grain(_filter_dates(actions, start, end, action_type), responses, outcomes)
    g = a.agg(
        F.count("action_id").alias("total_actions"),
        F.count_if(F.coalesce(F.col("n_paid_out"), F.lit(0)) > 0).alias("successful_actions"),
        F.count_if(F.coalesce(F.col("n_resp"), F.lit(0)) > 0).alias("got_response"),
        F.sum(F.col("w") * F.col("sum_days")).alias("wd"),
        F.sum(F.col("w") * F.col("n_days")).alias("wn"),
        F.sum(F.col("w") * F.col("sum_amt")).alias("wa"),
    )
    return g.select(
        "total_actions", "successful_actions",
        F.coalesce(E.round_dec(F.try_divide(F.col("successful_actions"), F.col("total_actions")), 6), F.lit(0.0)).alias("success_rate"),
        F.coalesce(E.round_dec(F.try_divide(F.col("got_response"), F.col("total_actions")), 6), F.lit(0.0)).alias("response_rate"),
        F.coalesce(E.round_dec(F.try_divide(F.col("wd"), F.col("wn")), 6), F.lit(0.0)).alias("avg_days_to_payment"),
        F.coalesce(F.col("wa"), F.lit(0)).cast("double").alias("total_amount_collected"),
    )


def action_effectiveness(actions: DataFrame, responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """AU-6: per action type: sent, responses, paid outcomes, mean days, amount, rates; most payments first."""
    a = _action_grain(actions, responses, outcomes)
    g = a.groupBy("action_type").agg(
        F.count("action_id").alias("total_sent"),
        F.coalesce(F.sum("n_resp"), F.lit(0)).alias("responses_received"),
        F.coalesce(F.sum("n_paid_out"), F.lit(0)).alias("payments_received"),
        F.sum(F.col("w") * F.col("sum_days")).alias("wd"),
        F.sum(F.col("w") * F.col("n_days")).alias("wn"),
        F.sum(F.col("w") * F.col("sum_amt")).alias("wa"),
    )
    return g.select(
        "action_type", "total_sent", F.col("responses_received").cast("long").alias("responses_received"),
        F.col("payments_received").cast("long").alias("payments_received"),
        E.round_dec(F.try_divide(F.col("wd"), F.col("wn")), 6).alias("avg_days_to_payment"),
        F.col("wa").cast("double").alias("total_collected"),
        E.pct("responses_received", "total_sent").alias("response_rate"),
        E.pct("payments_received", "total_sent").alias("payment_rate"),
    ).orderBy(F.desc("payments_received"), "action_type")


def _history(actions: DataFrame, responses: DataFrame, outcomes: DataFrame, loose: DataFrame) -> DataFrame:
    """Actions with their responses and outcomes (both by action_id), then the ``loose`` outcomes, one row each."""
    r = responses.select("action_id", "response_type", "response_date", "payment_promised")
    o = outcomes.select("action_id", "outcome_type", "amount_collected", "days_to_payment")
    listed = actions.join(r, "action_id", "left").join(o, "action_id", "left")
    return listed.unionByName(
        loose.select("invoice_id", "customer_id", "outcome_type", "amount_collected", "days_to_payment"), allowMissingColumns=True
    )


def _loose_outcomes(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes without a known action (no action_id, or one that is not in ``actions``), with the customer that the
    invoice's actions name, where there are any."""
    known = actions.groupBy("invoice_id").agg(F.min("customer_id").alias("customer_id"))
    return outcomes.join(actions.select("action_id"), "action_id", "left_anti").join(known, "invoice_id", "left")


def invoice_history(actions: DataFrame, responses: DataFrame, outcomes: DataFrame, invoice_id: str | None = None) -> DataFrame:
    """AU-3: history of one invoice, or of all when ``invoice_id`` is None: actions newest first, then outcomes logged
    without an action; each row with the number and amount of the invoice's outcomes."""
    mine = lambda df: df if invoice_id is None else df.where(F.col("invoice_id") == invoice_id)
    a, o = mine(actions), mine(outcomes)
    per_invoice = o.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("invoice_outcomes"),
        F.sum(F.col("amount_collected").cast("decimal(18,2)")).cast("double").alias("invoice_amount_collected"),
    )
    h = _history(a, responses, outcomes, _loose_outcomes(actions, o))
    # One summary row per invoice; an invoice with a large share of the history's rows (actions, their responses times
    # outcomes, or outcomes without an action) is salted across tasks.
    h = lookup_join(h, per_invoice, "invoice_id", "left", spread=["action_id", "response_date", "amount_collected"])
    return h.select(
        "invoice_id", "action_id", "action_date", "action_type", "channel", "sent_by", "response_type", "response_date",
        "payment_promised", "outcome_type", "amount_collected", "invoice_outcomes", "invoice_amount_collected",
    ).orderBy(F.desc_nulls_last("action_date"), "action_id", "invoice_id")


def customer_history(actions: DataFrame, responses: DataFrame, outcomes: DataFrame, customer_id: str | None = None) -> DataFrame:
    """AU-4: history of one customer (or all): actions newest first, then outcomes without an action."""
    mine = lambda df: df if customer_id is None else df.where(F.col("customer_id") == customer_id)
    h = _history(mine(actions), responses, outcomes, mine(_loose_outcomes(actions, outcomes)))
    return h.select(
        "customer_id", "invoice_id", "action_id", "action_date", "action_type", "channel", "response_type", "outcome_type",
    ).orderBy(F.desc_nulls_last("action_date"), "action_id", "invoice_id")


def audit_export(actions: DataFrame, responses: DataFrame, outcomes: DataFrame, start=None, end=None) -> DataFrame:
    """AU-7: the full audit log in an optional date range, newest first (write it with ``sources.tables.save``); outcomes
    without an action by their own date."""
    loose = _filter_dates(_loose_outcomes(actions, outcomes), start, end, date_col="outcome_date")
    h = _history(_filter_dates(actions, start, end), responses, outcomes, loose)
    return h.select(
        "action_id", "invoice_id", "customer_id", "action_type", "action_date", "channel", "sent_by", "response_type",
        "response_date", "payment_promised", "outcome_type", "amount_collected", "days_to_payment", "notes",
    ).orderBy(F.desc_nulls_last("action_date"), "action_id", "invoice_id")


def daily_success_metrics(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """AU-8: per action date and type: actions, successes, amount, mean days, success rate (no fan-out)."""
    a = actions.join(_outcomes_per_action(outcomes), "action_id", "left")
    g = a.groupBy(F.to_date("action_date").alias("metric_date"), "action_type").agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count_if(F.coalesce(F.col("n_paid_out"), F.lit(0)) > 0).alias("successful_actions"),
        F.coalesce(F.sum("sum_amt"), F.lit(0)).cast("double").alias("total_amount_collected"),
        F.sum("sum_days").alias("sd"),
        F.sum("n_days").alias("nd"),
    )
    return g.select(
        "metric_date", "action_type", "total_actions", "successful_actions", "total_amount_collected",
        E.round_dec(F.try_divide(F.col("sd"), F.col("nd")), 6).alias("avg_days_to_payment"),
        E.pct("successful_actions", "total_actions").alias("success_rate"),
    )

