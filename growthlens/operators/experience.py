"""Customer experience: monthly HEART scorecard and two deep dives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import seconds_between, ts_lit
from ..functions.ratios import pct, round_ratio
from ..plans.base import cohort_activity, customer_first, customer_spine, orders_delivered, session_funnel
from ..sources.star import Star


def month_spine(star: Star) -> DataFrame:
    """One row per month of the scorecard span (a parameter: bounded)."""
    p = star.params
    return star.spark.range(1).select(
        F.explode(F.sequence(F.lit(p.scorecard_first_month), F.lit(p.scorecard_last_month),
                             F.expr("INTERVAL 1 MONTH"))).alias("month"))


def heart_monthly(star: Star) -> DataFrame:
    od = orders_delivered(star)
    r = F.col("rating")
    orders_m = (od.groupBy(F.col("order_month").alias("month"))
                .agg(F.sum("rating").alias("_rs"), F.count("rating").alias("_rn"),
                     F.sum(F.when(r >= 4, 1).when(r.isNotNull(), 0)).alias("_r4"),
                     F.count(F.lit(1)).alias("_o"), F.countDistinct("customer_id").alias("_a"),
                     F.sum("is_perfect_order").alias("_p"))
                .select("month",
                        round_ratio("_rs", "_rn", 2).alias("avg_rating"),
                        pct("_r4", "_rn").alias("pct_rated_4plus"),
                        round_ratio("_o", "_a", 2).alias("orders_per_active"),
                        pct("_p", "_o").alias("perfect_order_pct")))
    sessions_m = (session_funnel(star).groupBy(F.col("session_month").alias("month"))
                  .agg(F.count(F.lit(1)).alias("_s"), F.countDistinct("customer_id").alias("_u"),
                       F.sum("converted").alias("_c"))
                  .select("month", round_ratio("_s", "_u", 2).alias("sessions_per_user"),
                          pct("_c", "_s").alias("session_conversion_pct")))
    cf = customer_first(star)
    adoption = (cf.groupBy(F.col("cohort_month").alias("month"))
                .agg(F.count(F.lit(1)).alias("_n"), F.sum("activated_7d").alias("_act"))
                .select("month", pct("_act", "_n").alias("activation_pct")))
    m1 = (cohort_activity(star).filter(F.col("month_offset") == 1)
          .groupBy("cohort_month").agg(F.count(F.lit(1)).alias("_m1")))
    retention = (customer_spine(star).groupBy("cohort_month").agg(F.count(F.lit(1)).alias("_n"))
                 .join(m1, "cohort_month", "left")
                 .select(F.add_months("cohort_month", 1).alias("month"),
                         pct(F.coalesce(F.col("_m1"), F.lit(0)), "_n").alias("m1_retention_pct")))
    out = month_spine(star)
    for part in (orders_m, sessions_m, adoption, retention):
        out = out.join(part, "month", "left")  # month-level sides: small, planner broadcasts
    return out.select("month", "avg_rating", "pct_rated_4plus", "orders_per_active", "sessions_per_user",
                      "activation_pct", "m1_retention_pct", "session_conversion_pct", "perfect_order_pct")


def _reorder_flags(star: Star) -> DataFrame:
    """Rated orders with a full window and whether the customer reordered in it.

    Reduced to (customer, day) first: an order at t reorders if a later order
    exists on its own day (t < that day's last order) or the first order of
    the customer's next active day falls inside the window.  The ``lead``
    window holds one row per active day of a customer, never all their orders.
    """
    p = star.params
    od = orders_delivered(star)
    days = (od.groupBy("customer_id", "order_date")
            .agg(F.max("order_ts").alias("day_last_ts"), F.min("order_ts").alias("day_first_ts")))
    days = days.withColumn("next_day_first_ts",
                           F.lead("day_first_ts").over(Window.partitionBy("customer_id").orderBy("order_date")))
    rated = od.filter(F.col("rating").isNotNull() & (F.col("order_ts") <= ts_lit(p.reorder_cutoff))) \
        .select("customer_id", "order_date", "order_ts", "rating")
    re = ((F.col("order_ts") < F.col("day_last_ts"))
          | (seconds_between("order_ts", "next_day_first_ts") <= p.reorder_window_days * 86400))
    return rated.join(days, ["customer_id", "order_date"]).withColumn("reordered", F.when(re, 1).otherwise(0))


def reorder_by_rating(star: Star) -> DataFrame:
    """After each rated order, another delivered order within (t, t + W days]?"""
    return (_reorder_flags(star).groupBy("rating")
            .agg(F.count(F.lit(1)).alias("rated_orders"), F.sum("reordered").alias("_re"))
            .select("rating", "rated_orders", pct("_re", "rated_orders").alias("pct_reordered_within_30d")))


def experience_class() -> F.Column:
    miss, late = F.col("items_missing") == 1, F.col("is_late_5plus") == 1
    return (F.when(miss & late, "4_late_and_incomplete")
             .when(miss, "3_incomplete")
             .when(late, "2_late_5plus")
             .when(F.col("is_on_time") == 0, "1_slightly_late")
             .otherwise("0_on_time_complete"))


def rating_by_experience(star: Star) -> DataFrame:
    od = orders_delivered(star).filter(F.col("rating").isNotNull())
    return (od.groupBy(experience_class().alias("experience"))
            .agg(F.count(F.lit(1)).alias("rated_orders"), F.sum("rating").alias("_rs"),
                 F.sum(F.when(F.col("rating") <= 2, 1).otherwise(0)).alias("_low"))
            .select("experience", "rated_orders", round_ratio("_rs", "rated_orders", 2).alias("avg_rating"),
                    pct("_low", "rated_orders").alias("pct_1_2_star")))
