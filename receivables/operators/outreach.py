"""Outreach message tables (OU-1..OU-7): template dimension + Spark string expressions, one row per message.

Templates are a tiny fixed table (one row per action type, or per channel and tone) broadcast to the invoices;
every placeholder is filled with a JVM string expression (``replace``, ``format_number``, ``date_format``), so a
million messages are one projection, not a Python loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.operators import outreach_templates as T


def payment_instructions(company_name: str = T.COMPANY_NAME, company_phone: str = T.COMPANY_PHONE,
                         payment_link: str | None = None) -> str:
    """OU-4: the payment options block (a constant per run)."""
    text = T.PAYMENT_INSTRUCTIONS_HEAD
    if payment_link:
        text += T.PAYMENT_INSTRUCTIONS_LINK.replace("{payment_link}", payment_link)
    return text + T.PAYMENT_INSTRUCTIONS_TAIL.replace("{company_name}", company_name).replace("{company_phone}", company_phone)


def render(template: Column, values: list[tuple[str, Column]]) -> Column:
    """Replace each ``token`` by its value, in order (free-text values should come last)."""
    out = template
    for token, value in values:
        out = F.replace(out, F.lit(token), value)
    return out


def select_targets(scored: DataFrame, top_n: int | None = None, invoice_id: str | None = None, by: str = "risk_score") -> DataFrame:
    """OU-1: one invoice, or the ``top_n`` open invoices by ``by`` (ties by invoice_id)."""
    if invoice_id is not None:
        return scored.where(F.col("invoice_id") == invoice_id)
    ranked = scored.where(F.col("status") == "open").orderBy(F.desc(by), "invoice_id")
    return ranked.limit(top_n) if top_n else ranked


def template_table(spark) -> DataFrame:
    rows = [(k, s, b, T.SMS_TEMPLATES[k]) for k, (s, b) in T.EMAIL_TEMPLATES.items()]
    return spark.createDataFrame(rows, "template_key string, subject_t string, body_t string, sms_t string")


def generate_messages(
    targets: DataFrame, customers: DataFrame, as_of, action_type: str | Column = T.DEFAULT_ACTION,
    company_name: str = T.COMPANY_NAME, company_phone: str = T.COMPANY_PHONE, company_email: str = T.COMPANY_EMAIL,
    payment_link: str | None = None,
) -> DataFrame:
    """OU-2 / OU-3 / OU-5: email subject and body, SMS text and its length (D20) for every target invoice.

    Targets need invoice_id, customer_id, invoice_amount, due_date and optionally risk_score. Targets whose
    customer is unknown are skipped. ``action_type`` is one type for all rows or a column (per-row types).
    """
    spark = targets.sparkSession
    act = F.lit(action_type) if isinstance(action_type, str) else action_type
    t = targets.withColumn("action_type", act)
    if "risk_score" not in t.columns:
        t = t.withColumn("risk_score", F.lit(0))
    keys = list(T.EMAIL_TEMPLATES)
    t = t.withColumn("template_key", F.when(F.col("action_type").isin(keys), F.col("action_type")).otherwise(F.lit(T.DEFAULT_ACTION)))
    c = customers.select("customer_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email"))
    j = t.join(c, "customer_id", "inner").join(F.broadcast(template_table(spark)), "template_key")
    days = E.days_overdue("due_date", as_of)
    amount = F.format_number("invoice_amount", 2)
    values = [
        ("{payment_instructions}", F.lit(payment_instructions(company_name, company_phone, payment_link))),
        ("{invoice_id}", F.col("invoice_id")),
        ("{amount}", amount),
        ("{amount0}", F.format_number("invoice_amount", 0)),
        ("{installment}", F.format_number(F.col("invoice_amount") / 3, 2)),
        ("{due_date}", F.date_format("due_date", "MMMM dd, yyyy")),
        ("{days_overdue}", days.cast("string")),
        ("{company_name}", F.lit(company_name)),
        ("{company_phone}", F.lit(company_phone)),
        ("{company_email}", F.lit(company_email)),
        ("{customer_name}", F.coalesce(F.col("customer_name"), F.col("customer_id"))),
    ]
    sms = render(F.col("sms_t"), values)
    return j.select(
        "invoice_id", "customer_id", "customer_name", "customer_email", "invoice_amount",
        days.alias("days_overdue"), "risk_score", "action_type",
        render(F.col("subject_t"), values).alias("email_subject"),
        render(F.col("body_t"), values).alias("email_body"),
        sms.alias("sms_text"),
        F.length(sms).alias("sms_length"),
    )


def tone_table(spark) -> DataFrame:
    tones = sorted({tone for _, tone in T.TONE_TEMPLATES})
    rows = [(tone, T.TONE_TEMPLATES.get(("email", tone)), T.TONE_TEMPLATES.get(("sms", tone))) for tone in tones]
    return spark.createDataFrame(rows, "message_tone string, email_t string, sms_t string")


def tone_messages(recs: DataFrame, as_of) -> DataFrame:
    """OU-6: render the tone templates chosen by RC-5 (email always; SMS only for tones that have one)."""
    spark = recs.sparkSession
    j = recs.join(F.broadcast(tone_table(spark)), "message_tone", "left")
    d = F.col("days_overdue")
    values = [
        ("{{ invoice_id }}", F.col("invoice_id")),
        ("{{ invoice_amount }}", F.col("invoice_amount").cast("string")),
        ("{{ due_date }}", F.col("due_date").cast("string")),
        (T.FRIENDLY_DAYS_LABEL, F.when(d > 0, F.lit("overdue")).otherwise(F.lit("until due"))),
        (T.FRIENDLY_DAYS_VALUE, F.when(d > 0, d).otherwise(E.days_until_due("due_date", as_of)).cast("string")),
        ("{{ days_overdue }}", d.cast("string")),
        ("{{ prior_reminders }}", F.col("prior_actions").cast("string")),
        ("{{ customer_name }}", F.coalesce(F.col("name"), F.col("customer_id"))),
    ]
    return j.select(
        "invoice_id", "customer_id", "message_tone",
        render(F.col("email_t"), values).alias("email_text"),
        render(F.col("sms_t"), values).alias("sms_text"),
    )


def log_messages(messages: DataFrame, sent_at, risk_col: str = "risk_category") -> DataFrame:
    """OU-7: sent messages as audit action rows; ``audit.append_batch`` gives them their ids and appends them."""
    risk = F.col(risk_col) if risk_col in messages.columns else F.lit("unknown")
    return messages.select(
        "invoice_id", "customer_id", "action_type",
        E.as_of_lit(sent_at).cast("timestamp_ntz").alias("action_date"),
        F.lit(None).cast("timestamp_ntz").alias("scheduled_date"),
        F.lit("email").alias("channel"), F.col("email_body").alias("message_sent"), F.lit("system").alias("sent_by"),
        F.concat(F.lit("Generated by CLI - Risk: "), F.coalesce(risk, F.lit("unknown"))).alias("notes"),
    )
