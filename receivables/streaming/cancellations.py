"""SC-8 as a stream: payments arriving on a file source cancel the pending follow-ups of their invoices.

``payments`` land as files (any micro-batch size); each batch joins the (static) schedule on invoice_id and emits
one cancellation row per pending action of a paid invoice. The sink is an append-only parquet table with a
checkpoint in the cluster's shared checkpoint folder, so a restarted or retried query neither loses nor repeats
output. Applying cancellations to a schedule is the same one-join update as the batch operator, and is idempotent.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from receivables.session import checkpoint_folder

PAYMENT_EVENT_SCHEMA = "payment_id string, invoice_id string, payment_date date, amount double, method string, status string"
REASON = "Payment received"


def cancellation_rows(payments_stream: DataFrame, schedule: DataFrame) -> DataFrame:
    """Streaming DataFrame of (invoice_id, attempt_number, cancelled_date, cancellation_reason, payment_id)."""
    pending = schedule.where(F.col("status") == "pending").select("invoice_id", "attempt_number")
    return payments_stream.select("invoice_id", "payment_id", "payment_date").join(pending, "invoice_id").select(
        "invoice_id", "attempt_number", F.col("payment_date").alias("cancelled_date"),
        F.lit(REASON).alias("cancellation_reason"), "payment_id",
    )


def start(spark: SparkSession, payments_dir: str, schedule: DataFrame, sink_dir: str, name: str = "cancellations",
          available_now: bool = True) -> StreamingQuery:
    """Run the stream from ``payments_dir`` into ``sink_dir`` (checkpoint under ``spark.checkpoint.dir``)."""
    payments = spark.readStream.schema(PAYMENT_EVENT_SCHEMA).parquet(payments_dir)
    out = cancellation_rows(payments, schedule)
    # One checkpoint per (query name, sink): a restart of the same stream resumes, a new sink starts fresh.
    sink_key = hashlib.sha1(sink_dir.encode()).hexdigest()[:12]
    ckpt = os.path.join(checkpoint_folder(spark), "streams", f"{name}-{sink_key}")
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.queryName(name).start()


def apply_cancellations(schedule: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Mark the cancelled (invoice_id, attempt_number) rows of a schedule; earliest cancellation date wins."""
    c = cancellations.groupBy("invoice_id", "attempt_number").agg(
        F.min("cancelled_date").alias("__date"),
        F.min_by("cancellation_reason", F.struct("cancelled_date", "cancellation_reason")).alias("__reason"),
    )
    j = schedule.join(c, ["invoice_id", "attempt_number"], "left")
    hit = F.col("__date").isNotNull() & (F.col("status") == "pending")
    return (
        j.withColumn("cancellation_reason", F.when(hit, F.col("__reason")).otherwise(F.col("cancellation_reason")))
        .withColumn("cancelled_date", F.when(hit, F.col("__date")).otherwise(F.col("cancelled_date")))
        .withColumn("status", F.when(hit, F.lit("cancelled")).otherwise(F.col("status")))
        .select(*schedule.columns)
    )
