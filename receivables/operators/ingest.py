"""Ingest raw retail transaction lines into receivables tables (ING-1..ING-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.functions.joins import lookup_join

# Country -> industry and country -> 2-letter code maps, with their defaults.
INDUSTRY_BY_COUNTRY = {
    "United Kingdom": "Retail", "Germany": "Manufacturing", "France": "Retail",
    "Netherlands": "Professional Services", "Switzerland": "Finance", "Australia": "Technology",
}
DEFAULT_INDUSTRY = "Retail"
CODE_BY_COUNTRY = {
    "United Kingdom": "UK", "Germany": "DE", "France": "FR", "Spain": "ES",
    "Netherlands": "NL", "Belgium": "BE", "Switzerland": "CH", "Australia": "AU",
}
DEFAULT_CODE = "UK"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros to ``width`` without ever truncating (Python ``str.zfill`` for digit strings)."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def clean_transactions(tx: DataFrame) -> DataFrame:
    """ING-1: drop cancelled ('C…') invoices, lines without customer, non-positive quantity or price; add amount."""
    return tx.where(
        ~F.col("invoice_no").cast("string").startswith("C")
        & F.col("customer_key").isNotNull()
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0)
    ).withColumn("amount", F.col("quantity") * F.col("unit_price"))


def _first(c: str) -> Column:
    # "first" in file order: the earliest line by (invoice_date, invoice_no, line_no) -- deterministic on any layout.
    return F.min_by(F.col(c), F.struct("invoice_date", "invoice_no", "line_no"))


def build_customers(clean: DataFrame) -> DataFrame:
    """ING-2: one customer per customer key with country, first date, lifetime value, terms tier and limit."""
    g = clean.groupBy("customer_key").agg(
        _first("country").alias("country_name"),
        F.min("invoice_date").alias("first_date"),
        F.sum("amount").alias("lifetime"),
    )
    key = F.col("customer_key").cast("long").cast("string")
    cid = F.concat(F.lit("CUST-"), zfill(key, 5))
    return g.select(
        cid.alias("customer_id"),
        F.concat(F.lit("Customer "), key).alias("name"),
        F.concat(F.lower(cid), F.lit("@company.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.coalesce(_map(INDUSTRY_BY_COUNTRY)[F.col("country_name")], F.lit(DEFAULT_INDUSTRY)).alias("industry"),
        F.coalesce(_map(CODE_BY_COUNTRY)[F.col("country_name")], F.lit(DEFAULT_CODE)).alias("country"),
        F.lit(None).cast("string").alias("state"),
        F.when(F.col("lifetime") > 50000, 60).when(F.col("lifetime") > 20000, 45).otherwise(30).alias("payment_terms_days"),
        E.money2(F.col("lifetime") * 2).alias("credit_limit"),
        F.date_format("first_date", "yyyy-MM-dd").alias("created_at"),
        F.col("customer_key").alias("source_key"),
    )


def build_invoices(clean: DataFrame, customers: DataFrame) -> DataFrame:
    """ING-3: one invoice per invoice number; due = issue + customer terms (30 when unknown).

    The id derives from the invoice number itself (not a global row position), so no single-partition numbering is
    needed. Paid / open status is not simulated: new invoices start ``open``.
    """
    g = clean.groupBy("invoice_no").agg(
        _first("customer_key").alias("customer_key"),
        _first("invoice_date").alias("invoice_date"),
        F.sum("amount").alias("total"),
    )
    cust = customers.select(F.col("source_key").alias("customer_key"), "customer_id", "payment_terms_days")
    # One row per customer on the right; a customer with a large share of the invoices is salted across tasks.
    j = lookup_join(g, cust, "customer_key", "inner", spread="invoice_no")
    issue = F.to_date("invoice_date")
    return j.select(
        F.concat(F.lit("INV-"), zfill(F.col("invoice_no").cast("string"), 6)).alias("invoice_id"),
        "customer_id",
        issue.alias("issue_date"),
        F.date_add(issue, F.coalesce(F.col("payment_terms_days"), F.lit(30))).alias("due_date"),
        E.money2("total").alias("invoice_amount"),
        F.lit("GBP").alias("currency"),
        F.lit("open").alias("status"),
        F.lit("one_time").alias("invoice_type"),
        F.lit("online").alias("channel"),
        issue.alias("created_at"),
    )
