"""Activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import pct
from ..plans.base import customer_first, session_funnel
from ..sources.star import Star


def activation_by_month_channel(star: Star) -> DataFrame:
    return (customer_first(star).groupBy("cohort_month", "acquisition_channel")
            .agg(F.count(F.lit(1)).alias("signups"), F.sum("activated_7d").alias("activated"))
            .withColumn("activation_pct", pct("activated", "signups")))


def activation_by_platform(star: Star) -> DataFrame:
    return (customer_first(star).groupBy("platform")
            .agg(F.count(F.lit(1)).alias("signups"), F.sum("activated_7d").alias("_a"))
            .select("platform", "signups", pct("_a", "signups").alias("activation_pct")))


def time_to_first_order_bucket(star: Star) -> F.Column:
    dtf = F.col("days_to_first_order")
    return (F.when(F.col("never_ordered") == 1, "7_never")
             .when(dtf < 1, "1_same_day")
             .when(dtf < 2, "2_next_day")
             .when(dtf <= 3, "3_within_3d")
             .when(dtf <= star.params.activation_days, "4_within_7d")
             .when(dtf <= 30, "5_8_to_30d")
             .otherwise("6_over_30d"))


def time_to_first_order(star: Star) -> DataFrame:
    """Bucket counts and share of all customers (window over the 7-row result)."""
    counts = (customer_first(star).groupBy(time_to_first_order_bucket(star).alias("time_to_first_order"))
              .agg(F.count(F.lit(1)).alias("customers")))
    total = F.sum("customers").over(Window.partitionBy())
    return counts.select("time_to_first_order", "customers", pct(F.col("customers"), total).alias("pct"))


def first_sessions(star: Star) -> DataFrame:
    """Each customer's chronologically first session (by start, session id).

    ``min`` over a struct keyed by (start, id) is a partial aggregate, so a user
    with millions of sessions is reduced map-side.
    """
    sf = session_funnel(star)
    first = F.min(F.struct("session_start", "session_id", "reached_pv", "reached_cart", "converted")).alias("s")
    return (sf.groupBy("customer_id").agg(first)
              .select("customer_id", F.col("s.reached_pv").alias("s1_viewed"),
                      F.col("s.reached_cart").alias("s1_carted"), F.col("s.converted").alias("s1_ordered")))


def first_session_depth(star: Star) -> DataFrame:
    depth = (F.when(F.col("s1_ordered") == 1, "4_ordered_in_session_1")
              .when(F.col("s1_carted") == 1, "3_reached_cart")
              .when(F.col("s1_viewed") == 1, "2_viewed_product")
              .otherwise("1_bounced_at_open"))
    cf = customer_first(star).select("customer_id", "activated_7d")
    return (first_sessions(star).join(cf, "customer_id")
            .groupBy(depth.alias("first_session_depth"))
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("activated_7d").alias("_a"))
            .select("first_session_depth", "customers", pct("_a", "customers").alias("activation_pct")))
