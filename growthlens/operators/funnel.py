"""Conversion funnel on the session roll-up.

Reach semantics: a session reached a stage if it contains the stage's event,
in any order (the event log is not time-monotone within a session).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import seconds_between
from ..functions.ratios import pct, round_ratio
from ..plans.base import session_funnel, zone_group
from ..sources.star import Star


def funnel_overall(star: Star) -> DataFrame:
    f = session_funnel(star).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("reached_pv").alias("pv"),
        F.sum("reached_cart").alias("cart"), F.sum("reached_checkout").alias("checkout"),
        F.sum("converted").alias("paid"))
    stages = F.expr("""stack(5,
        1, 'app_open', sessions, sessions,
        2, 'product_view', pv, sessions,
        3, 'add_to_cart', cart, pv,
        4, 'checkout_start', checkout, cart,
        5, 'payment_success', paid, checkout) AS (stage_order, stage, reached, prev_stage)""")
    return (f.select(stages, "sessions")
            .select("stage", "reached",
                    pct("reached", "sessions").alias("pct_of_sessions"),
                    pct("reached", "prev_stage").alias("step_conversion_pct")))


def conversion_by_month(star: Star) -> DataFrame:
    return (session_funnel(star).groupBy("session_month")
            .agg(F.count(F.lit(1)).alias("sessions"), F.sum("converted").alias("orders"))
            .withColumn("conversion_pct", pct("orders", "sessions")))


def funnel_by_platform(star: Star) -> DataFrame:
    a = session_funnel(star).groupBy("platform").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("reached_pv").alias("_pv"),
        F.sum("reached_cart").alias("_cart"), F.sum("reached_checkout").alias("_co"),
        F.sum("converted").alias("_paid"))
    return a.select("platform", "sessions",
                    pct("_pv", "sessions").alias("pv_pct"), pct("_cart", "sessions").alias("cart_pct"),
                    pct("_co", "sessions").alias("checkout_pct"), pct("_paid", "sessions").alias("conversion_pct"))


def search_vs_browse(star: Star) -> DataFrame:
    sf = session_funnel(star)
    secs = F.when(F.col("converted") == 1, seconds_between("session_start", "payment_ts"))
    return (sf.groupBy(F.when(F.col("used_search") == 1, "searched").otherwise("browsed_only").alias("path"))
            .agg(F.count(F.lit(1)).alias("sessions"), F.sum("converted").alias("_paid"),
                 F.sum(secs).alias("_secs"), F.count(secs).alias("_n"))
            .select("path", "sessions", pct("_paid", "sessions").alias("conversion_pct"),
                    round_ratio("_secs", F.col("_n") * 60, 1).alias("avg_min_to_order")))


def cart_checkout_by_zone_period(star: Star) -> DataFrame:
    p = star.params
    # (customer, month) partial sums first: one customer's sessions never pile up in the join
    sf = (session_funnel(star).groupBy("customer_id", "session_month")
          .agg(F.sum("reached_cart").alias("_cart"), F.sum("reached_checkout").alias("_chk")))
    c = star.customer.select("customer_id", "home_store_id")
    period = F.when(F.col("session_month") >= F.lit(p.stress_start), "may_onward").otherwise("before_may")
    return (sf.join(c, "customer_id")
            .groupBy(zone_group("home_store_id", star).alias("zone_group"), period.alias("period"))
            .agg(F.sum("_cart").alias("cart_sessions"), F.sum("_chk").alias("checkout_sessions"))
            .withColumn("cart_to_checkout_pct", pct("checkout_sessions", "cart_sessions")))
