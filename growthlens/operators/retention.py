"""Retention cohorts.

Cohort = signup month; a customer is active in M_k if they have a delivered
order k calendar months after it.  Percentages are over all signups.  Cells a
cohort has not lived through yet (beyond the observation month) are NULL; m0
alone is NULL rather than 0 when nobody ordered (T14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_between_boundaries
from ..functions.ratios import pct
from ..plans.base import cohort_activity, customer_spine, orders_delivered
from ..sources.star import Star


def cohort_sizes(star: Star) -> DataFrame:
    return customer_spine(star).groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))


def _cohort_cells(star: Star, offsets: list[int]) -> DataFrame:
    """cohort_month, cohort_size, max_offset and one actives column per offset."""
    act = (cohort_activity(star).filter(F.col("month_offset").isin(offsets))
           .groupBy("cohort_month").pivot("month_offset", offsets).agg(F.count(F.lit(1))))
    for k in offsets:
        act = act.withColumnRenamed(str(k), f"a{k}")
    return (cohort_sizes(star).join(act, "cohort_month", "left")
            .withColumn("max_offset",
                        months_between_boundaries("cohort_month", F.lit(star.params.observation_month))))


def _cell(k: int) -> F.Column:
    if k == 0:
        return pct(F.col("a0"), "cohort_size")
    return F.when(F.col("max_offset") >= k, pct(F.coalesce(F.col(f"a{k}"), F.lit(0)), "cohort_size"))


def retention_triangle(star: Star) -> DataFrame:
    offsets = list(range(star.params.retention_offsets))
    cells = _cohort_cells(star, offsets)
    return cells.select("cohort_month", "cohort_size", *[_cell(k).alias(f"m{k}") for k in offsets])


def retention_m1_m3_m6(star: Star) -> DataFrame:
    cells = _cohort_cells(star, [1, 3, 6])
    note = F.when(F.col("cohort_month") == F.lit(star.params.promo_cohort), "PROMO COHORT").otherwise("")
    return cells.select("cohort_month", "cohort_size", note.alias("note"),
                        _cell(1).alias("m1_pct"), _cell(3).alias("m3_pct"), _cell(6).alias("m6_pct"))


def _m1_flags(star: Star) -> DataFrame:
    return (cohort_activity(star).filter(F.col("month_offset") == 1)
            .select("customer_id", F.lit(1).alias("active_m1")))


def m1_by_channel(star: Star) -> DataFrame:
    cf = (customer_spine(star).filter(F.col("cohort_month") <= F.lit(star.params.last_full_m1_cohort))
          .select("customer_id", "acquisition_channel"))
    return (cf.join(_m1_flags(star), "customer_id", "left")
            .groupBy("acquisition_channel")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum(F.coalesce("active_m1", F.lit(0))).alias("_m1"))
            .select("acquisition_channel", "customers", pct("_m1", "customers").alias("m1_retention_pct")))


def discount_profile(star: Star) -> DataFrame:
    """Per ordering customer: delivered orders and how many carried a discount."""
    return (orders_delivered(star).groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.sum(F.when(F.col("discount_amount") > 0, 1).otherwise(0)).alias("discounted")))


def buyer_type(star: Star) -> F.Column:
    share = star.params.discount_led_share_pct
    return F.when(F.col("discounted") * 100 >= F.col("orders") * share, "discount_led").otherwise("full_price_led")


def m1_by_buyer_type(star: Star) -> DataFrame:
    p = star.params
    cf = (customer_spine(star).filter(F.col("cohort_month") <= F.lit(p.last_full_m1_cohort))
          .select("customer_id", "cohort_month"))
    group = F.when(F.col("cohort_month") == F.lit(p.promo_cohort), "may_2026").otherwise("other_cohorts")
    return (cf.join(discount_profile(star), "customer_id")
            .join(_m1_flags(star), "customer_id", "left")
            .groupBy(group.alias("cohort_group"), buyer_type(star).alias("buyer_type"))
            .agg(F.count(F.lit(1)).alias("customers"), F.sum(F.coalesce("active_m1", F.lit(0))).alias("_m1"))
            .select("cohort_group", "buyer_type", "customers", pct("_m1", "customers").alias("m1_retention_pct")))
