"""Cash forecasting (FC-1..FC-6), including a reproducible Monte Carlo that runs as one Spark job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.functions import expr as E

# The default payment pattern used when there is no payment history.
DEFAULT_AVG_DAYS_AFTER_DUE = 7.0
DEFAULT_STD_DAYS_AFTER_DUE = 14.0
DEFAULT_PAYMENT_PROBABILITY = 0.8


def payment_pattern(invoices: DataFrame, payments: DataFrame | None) -> DataFrame:
    """FC-1: mean / sample std of days paid after due and pairs-per-invoice probability. One row.

    Falls back to the fixed defaults when there is no payment table or no invoice has a payment.
    """
    if payments is None:
        return invoices.sparkSession.range(1).select(
            F.lit(DEFAULT_AVG_DAYS_AFTER_DUE).alias("avg_days_after_due"),
            F.lit(DEFAULT_STD_DAYS_AFTER_DUE).alias("std_days_after_due"),
            F.lit(DEFAULT_PAYMENT_PROBABILITY).alias("payment_probability"),
        )
    pairs = invoices.select("invoice_id", "due_date").join(
        payments.select("invoice_id", "payment_date"), "invoice_id"
    ).select(F.datediff("payment_date", "due_date").alias("days_after_due"))
    p = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("days_after_due").alias("avg_d"),
        F.stddev_samp("days_after_due").alias("std_d"),
    )
    n = invoices.agg(F.count(F.lit(1)).alias("n_invoices"))
    j = p.crossJoin(n)
    none = F.col("pairs") == 0
    return j.select(
        F.when(none, DEFAULT_AVG_DAYS_AFTER_DUE).otherwise(F.col("avg_d")).alias("avg_days_after_due"),
        F.when(none, DEFAULT_STD_DAYS_AFTER_DUE).otherwise(F.col("std_d")).alias("std_days_after_due"),
        F.when(none | (F.col("n_invoices") == 0), DEFAULT_PAYMENT_PROBABILITY)
        .otherwise(F.col("pairs") / F.col("n_invoices"))
        .alias("payment_probability"),
    )


def forecast_inflows(invoices: DataFrame, payments: DataFrame | None, as_of, horizons=(7, 14, 30)) -> DataFrame:
    """FC-2: probability-weighted open AR expected within each horizon (cumulative, no lower bound, D10)."""
    a = E.as_of_lit(as_of)
    pat = F.broadcast(payment_pattern(invoices, payments))  # one row
    open_inv = invoices.where(F.col("status") == "open").select("due_date", "invoice_amount")
    j = open_inv.crossJoin(pat)
    expected = F.date_add("due_date", F.col("avg_days_after_due").cast("int"))
    d = F.datediff(expected, a)
    aggs = [
        F.coalesce(F.sum(F.when(d <= h, F.col("invoice_amount").cast("decimal(18,2)"))), F.lit(0)).alias(f"s{h}")
        for h in horizons
    ]
    g = j.agg(*aggs).crossJoin(pat)
    return g.select(
        *[E.money2(F.coalesce(F.col(f"s{h}"), F.lit(0)).cast("double") * F.col("payment_probability")).alias(f"forecast_{h}d")
          for h in horizons]
    )


# Uniform draws are (h + 1) / (2^32 + 1) for a 32-bit hash h, so u >= 1 / (2^32 + 1) and the Box-Muller normal
# sqrt(-2 ln u) * cos(.) can never exceed Z_MAX in absolute value. This is an exact bound of the generator, used to
# skip invoices whose payment could not land in the horizon under any draw.
Z_MAX = math.sqrt(-2.0 * math.log(1.0 / (2.0**32 + 1))) + 1e-9


def _uniform32(hex_digest: Column, chunk: int) -> Column:
    """Uniform in (0, 1) from the ``chunk``-th group of 32 bits of a hex digest."""
    h = F.conv(F.substring(hex_digest, 1 + 8 * chunk, 8), 16, 10).cast("bigint")
    return (h + 1) / F.lit(2.0**32 + 1)


def draw_key(invoice_id: Column, scenario: Column, seed: int) -> Column:
    return F.concat_ws("|", invoice_id, scenario.cast("string"), F.lit(str(seed)))


def cash_scenarios(
    invoices: DataFrame, payments: DataFrame | None, as_of, n_scenarios: int = 100, days_ahead: int = 30,
    seed: int = 42,
) -> DataFrame:
    """FC-3: Monte Carlo collections per scenario within ``days_ahead`` of ``as_of``.

    Each (invoice, scenario) pair takes one md5 of (invoice_id, scenario, seed); its first three 32-bit groups give
    paid ~ Bernoulli(p) and the two Box-Muller uniforms for delay = max(0, Normal(avg, std)). The draws depend only
    on the key, not on partitioning or task retries. Two exact prunings run before the scenario expansion: invoices
    due after ``as_of + days_ahead`` can never count (delay >= 0), and invoices due before
    ``as_of - (avg + std * Z_MAX)`` can never reach ``as_of`` (the generator's normal is bounded by Z_MAX). The
    scenario axis is an ``n_scenarios``-row broadcast; the only shuffle is the per-scenario partial sum.
    """
    spark = invoices.sparkSession
    a = E.as_of_lit(as_of)
    pat = F.broadcast(payment_pattern(invoices, payments))
    max_delay = F.ceil(F.greatest(F.lit(0.0), F.col("avg_days_after_due") + F.abs(F.col("std_days_after_due")) * Z_MAX)).cast("int")
    cand = (
        invoices.where((F.col("status") == "open") & (F.col("due_date") <= F.date_add(a, days_ahead)))
        .select("invoice_id", "due_date", "invoice_amount")
        .crossJoin(pat)
        .where(F.col("due_date") >= F.date_sub(a, max_delay + 1))
    )
    scen = F.broadcast(spark.range(1, n_scenarios + 1).withColumnRenamed("id", "scenario"))
    x = cand.crossJoin(scen).withColumn("h", F.md5(draw_key(F.col("invoice_id"), F.col("scenario"), seed)))
    u1, u2, u3 = (_uniform32(F.col("h"), i) for i in range(3))
    z = F.sqrt(F.lit(-2.0) * F.ln(u2)) * F.cos(F.lit(2 * math.pi) * u3)
    delay = F.greatest(F.lit(0.0), F.col("avg_days_after_due") + F.col("std_days_after_due") * z)
    pay_day = F.date_add("due_date", delay.cast("int"))
    d = F.datediff(pay_day, a)
    hit = (u1 < F.col("payment_probability")) & (d >= 0) & (d <= days_ahead)
    per = x.where(hit).groupBy("scenario").agg(F.sum(F.col("invoice_amount").cast("decimal(18,2)")).alias("tc"))
    all_s = spark.range(1, n_scenarios + 1).withColumnRenamed("id", "scenario")
    return all_s.join(per, "scenario", "left").select(
        F.col("scenario").cast("int").alias("scenario"),
        F.coalesce(F.col("tc"), F.lit(0)).cast("double").alias("total_collected"),
        F.lit(days_ahead).alias("days_ahead"),
    )


def scenario_percentiles(scenarios: DataFrame) -> DataFrame:
    """FC-4: P10 / P50 / P90 (linear interpolation) and the mean of scenario totals."""
    q = scenarios.agg(
        F.percentile("total_collected", [0.1, 0.5, 0.9]).alias("q"),
        F.avg("total_collected").alias("m"),
    )
    return q.select(
        E.money2(F.col("q")[0]).alias("p10"),
        E.money2(F.col("q")[1]).alias("p50"),
        E.money2(F.col("q")[2]).alias("p90"),
        E.money2("m").alias("mean"),
    )


def collection_impact(invoices: DataFrame, target_ids: DataFrame, success_probability: float = 0.9) -> DataFrame:
    """FC-5: total and expected collection of the targeted invoices (any status)."""
    t = invoices.join(target_ids.select("invoice_id").distinct(), "invoice_id", "left_semi")
    g = t.agg(
        F.coalesce(F.sum(F.col("invoice_amount").cast("decimal(18,2)")), F.lit(0)).alias("tot"),
        F.count(F.lit(1)).alias("invoice_count"),
    )
    return g.select(
        F.col("tot").cast("double").alias("total_targeted"),
        E.money2(F.col("tot").cast("double") * success_probability).alias("expected_collection"),
        F.lit(success_probability).alias("success_probability"),
        "invoice_count",
    )


def cash_gap(invoices: DataFrame, as_of, forecast_days: int = 30, collection_rate: float = 0.8) -> DataFrame:
    """FC-6: open AR minus the expected collection of invoices due in [as_of, as_of + N]."""
    a = E.as_of_lit(as_of)
    o = invoices.where(F.col("status") == "open")
    soon = (F.col("due_date") >= a) & (F.col("due_date") <= F.date_add(a, forecast_days))
    dec = F.col("invoice_amount").cast("decimal(18,2)")
    g = o.agg(
        F.coalesce(F.sum(dec), F.lit(0)).alias("ar"),
        F.coalesce(F.sum(F.when(soon, dec)), F.lit(0)).alias("soon"),
    )
    expected = F.col("soon").cast("double") * collection_rate
    gap = F.col("ar").cast("double") - expected
    return g.select(
        F.col("ar").cast("double").alias("total_ar"),
        E.money2(expected).alias("expected_collections"),
        E.money2(gap).alias("cash_gap"),
        F.when(F.col("ar") > 0, E.round_dec(gap / F.col("ar").cast("double") * 100, 2)).otherwise(0.0).alias("gap_percentage"),
        F.lit(forecast_days).alias("forecast_days"),
    )
