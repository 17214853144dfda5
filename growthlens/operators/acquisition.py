"""Acquisition & CAC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start, months_between_boundaries, seconds_between
from ..functions.ratios import pct, round_ratio
from ..plans.base import customer_first, customer_spine, order_margin, orders_delivered
from ..plans.skew import hot_keys, join_per_key
from ..sources.star import Star


def spend_by_channel(star: Star) -> DataFrame:
    """Total spend per channel (one row per channel: tiny, broadcast-safe)."""
    return star.spend.groupBy("channel").agg(F.sum("spend_inr").alias("spend_inr"))


def cac(spend, customers) -> F.Column:
    """Cost per customer; channels without paid spend have no CAC (NULL)."""
    return round_ratio(F.nullif(F.col(spend) if isinstance(spend, str) else spend, F.lit(0)), customers, 0)


def signups_by_month_channel(star: Star) -> DataFrame:
    return (star.customer.groupBy(month_start("signup_ts").alias("signup_month"), "acquisition_channel")
            .agg(F.count(F.lit(1)).alias("new_customers")))


def cac_by_channel(star: Star) -> DataFrame:
    cust = (customer_first(star).groupBy("acquisition_channel")
            .agg(F.count(F.lit(1)).alias("signups"),
                 F.sum("activated_7d").alias("activated"),
                 F.sum(1 - F.col("never_ordered")).alias("ever_ordered")))
    s = spend_by_channel(star).withColumnRenamed("channel", "acquisition_channel")
    return (cust.join(F.broadcast(s), "acquisition_channel", "left")
            .select("acquisition_channel", "signups", "spend_inr",
                    cac("spend_inr", "signups").alias("cac_per_signup"),
                    pct("activated", "signups").alias("activation_rate_pct"),
                    cac("spend_inr", "activated").alias("cac_per_activated"),
                    pct("ever_ordered", "signups").alias("ever_ordered_pct")))


def cac_payback(star: Star) -> DataFrame:
    p = star.params
    cf = customer_spine(star)
    tenure = months_between_boundaries("cohort_month", "order_month")
    # (customer, month) partial sums first: the join input per customer is bounded by the calendar
    per_cm = (order_margin(star).groupBy("customer_id", "order_month")
              .agg(F.sum("contribution_rs").alias("contribution_rs")))
    per_month = (per_cm.join(cf.select("customer_id", "cohort_month", "acquisition_channel"), "customer_id")
                 .groupBy("acquisition_channel", tenure.alias("tenure_month"))
                 .agg(F.sum("contribution_rs").alias("contribution_rs"))
                 .filter(F.col("tenure_month") <= p.payback_max_tenure))
    size = cf.groupBy("acquisition_channel").agg(F.count(F.lit(1)).alias("n_customers"))
    s = spend_by_channel(star).withColumnRenamed("channel", "acquisition_channel")
    w = (Window.partitionBy("acquisition_channel").orderBy("tenure_month")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = F.sum("contribution_rs").over(w)
    return (per_month.join(size, "acquisition_channel").join(F.broadcast(s), "acquisition_channel", "left")
            .withColumn("cum", cum)
            .select("acquisition_channel", "tenure_month",
                    round_ratio("contribution_rs", "n_customers", 1).alias("contribution_per_cust"),
                    round_ratio("cum", "n_customers", 1).alias("cum_contribution_per_cust"),
                    cac("spend_inr", "n_customers").alias("cac_per_signup"),
                    F.when((F.col("spend_inr") > 0) & (F.col("cum") >= F.col("spend_inr")), "paid back")
                    .otherwise("").alias("payback_status")))


def payback_month_by_channel(star: Star) -> DataFrame:
    """The first tenure month by which a channel's cumulative contribution covers its spend; NULL if none does."""
    paid = F.when(F.col("payback_status") == "paid back", F.col("tenure_month"))
    return cac_payback(star).groupBy("acquisition_channel").agg(F.min(paid).alias("payback_month"))


def channel_scorecard(star: Star) -> DataFrame:
    p = star.params
    cf = customer_first(star).filter(F.col("cohort_month") <= F.lit(p.last_full_m1_cohort))
    spine = customer_spine(star).filter(F.col("cohort_month") <= F.lit(p.last_full_m1_cohort))
    od = orders_delivered(star).select("customer_id", "order_month").distinct()
    m1 = (od.join(spine.select("customer_id", "cohort_month"), "customer_id")
          .filter(months_between_boundaries("cohort_month", "order_month") == 1)
          .select("customer_id").distinct().withColumn("active_m1", F.lit(1)))
    om = order_margin(star).select("customer_id", "order_ts", "contribution_rs")
    # hot customers counted on the delivered orders (one scan), not on the margin join behind om
    hot = hot_keys(orders_delivered(star), "customer_id", p.hot_key_rows)
    d90 = (join_per_key(om, spine.select("customer_id", "signup_ts"), "customer_id", p.hot_key_rows, hot=hot)
           .filter(seconds_between("signup_ts", "order_ts") < p.scorecard_days * 86400)
           .groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("orders_90d"), F.sum("contribution_rs").alias("contribution_90d")))
    s = spend_by_channel(star).withColumnRenamed("channel", "acquisition_channel")
    per = (cf.select("customer_id", "acquisition_channel", "activated_7d")
           .join(m1, "customer_id", "left").join(d90, "customer_id", "left"))
    agg = per.groupBy("acquisition_channel").agg(
        F.count(F.lit(1)).alias("signups"),
        F.sum("activated_7d").alias("_act"),
        F.sum(F.coalesce("active_m1", F.lit(0))).alias("_m1"),
        F.sum(F.coalesce("orders_90d", F.lit(0))).alias("_o90"),
        F.sum("contribution_90d").alias("_c90"),
        F.count("contribution_90d").alias("_n90"))
    return (agg.join(F.broadcast(s), "acquisition_channel", "left")
            .select("acquisition_channel", "signups",
                    pct("_act", "signups").alias("activation_pct"),
                    pct("_m1", "signups").alias("m1_retention_pct"),
                    round_ratio("_o90", "signups", 2).alias("avg_orders_90d"),
                    round_ratio("_c90", "_n90", 0).alias("avg_contribution_90d"),
                    cac("spend_inr", "signups").alias("cac_per_signup")))
