"""Churn feature table: one row per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day
from ..operators.aggregates import sum_if
from ..operators.sets import union_fallback

# Which term texts set which flag.
TERM_FLAGS = {
    "subscription_length_36_mths": "%36 %", "subscription_length_12_mths": "%12 %", "subscription_length_1_mths": "%1 %",
    "billing_every_12_mths": "% yearly%", "billing_every_6_mths": "% bi-yearly%", "billing_every_3_mths": "% quarterly%",
    "billing_every_1_mths": "% monthly%",
}
ENDED = ["cancelled", "non_renewing"]
EARLY_CHURN_DAYS, CUTOFF_DAYS = 100, 120


def _last_month_rows(report: DataFrame, valued: Column) -> DataFrame:
    """All rows of each customer's last month that has a valued row."""
    last = report.filter(valued).groupBy("customer_id").agg(F.max("reporting_month").alias("reporting_month"))
    return report.join(last, ["customer_id", "reporting_month"], "left_semi")


def _features(rows: DataFrame, customers: DataFrame, products: list[str], as_of) -> DataFrame:
    """Flags (true or NULL), revenue in total and by product, and the customer's dates."""
    seen = lambda condition: F.bool_or(F.when(condition, True))
    terms, amount = F.col("product_terms"), F.col("mrr_eur")
    flags = [seen(terms.like(pattern)).alias(name) for name, pattern in TERM_FLAGS.items()]
    sums = [F.sum(amount).alias("mrr")] + [sum_if(F.col("product_group") == p, amount).alias(f"mrr_{p.lower()}") for p in products]
    per_customer = rows.groupBy("customer_id").agg(*flags, seen(F.col("invoice_discount_pct") > 0).alias("has_discount"), *sums)
    cancelled = F.col("max_cancelled_dt")
    reference = F.coalesce(cancelled, day(as_of))
    profile = customers.select(
        "customer_id", "is_fleet", "country", "customer_status", "system", F.col("first_start_dt"),
        F.when(F.col("customer_status").isin(ENDED), cancelled).alias("cancelled_dt"),
        reference.alias("reference_dt"), F.date_sub(reference, CUTOFF_DAYS).alias("cutoff_start_dt"),
    )
    return profile.join(per_customer, "customer_id")


def churn_features(report: DataFrame, fallback: DataFrame, customers: DataFrame, products: list[str], as_of) -> DataFrame:
    """Features of customers with revenue, and from ``fallback`` of ended customers without any.

    report: customer_id, reporting_month, product_terms, product_group, invoice_discount_pct, mrr_eur,
    flag_future. fallback: the same with amount and exchange_rate for mrr_eur. Customers that started and
    cancelled in the same month are left out.
    """
    paid = _last_month_rows(report, (F.col("mrr_eur") > 0) & ~F.col("flag_future"))
    with_revenue = _features(paid, customers, products, as_of)

    unpaid = _last_month_rows(fallback, F.col("amount") > 0).withColumn("mrr_eur", F.col("amount") / F.col("exchange_rate"))
    without = _features(unpaid, customers.filter(F.col("customer_status").isin(ENDED)), products, as_of)
    rounded = {c: F.round(c, 2).cast("decimal(18,2)") for c in ["mrr", *[f"mrr_{p.lower()}" for p in products]]}

    everyone = union_fallback(
        with_revenue.withColumns({c: F.col(c).cast("decimal(18,2)") for c in rounded}).withColumn("had_revenue", F.lit(True)),
        without.withColumns(rounded).withColumn("had_revenue", F.lit(False)), ["customer_id"],
    )
    cancelled, start = F.col("cancelled_dt"), F.col("first_start_dt")
    same_month = F.trunc(start, "month") == F.coalesce(F.trunc(cancelled, "month"), day("2100-01-01"))
    lived = F.datediff(cancelled, start)
    return everyone.filter(~same_month).withColumns({
        "churn_flag": cancelled.isNotNull(),
        "churn_100d_flag": F.coalesce(lived <= EARLY_CHURN_DAYS, F.lit(False)),
        "tenure_days": F.datediff(F.coalesce(cancelled, day(as_of)), start),
    })
