"""Churn & lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between, ts_lit
from ..functions.ratios import pct, round_ratio
from ..plans.base import customer_first, flag, orders_delivered, zone_group
from ..sources.star import Star

BAD_FIRST = "bad_first_order (late>5m or incomplete)"
GOOD_FIRST = "good_first_order"


def first_experience(col: str = "bad_first_experience") -> F.Column:
    return F.when(F.col(col) == 1, BAD_FIRST).otherwise(GOOD_FIRST)


def customer_orders(star: Star) -> DataFrame:
    """Per ordering customer: last order, lifetime orders / GMV / net, recency."""
    def build():
        p = star.params
        return (orders_delivered(star).groupBy("customer_id")
                .agg(F.max("order_ts").alias("last_order_ts"),
                     F.count(F.lit(1)).alias("lifetime_orders"),
                     F.sum("item_total").alias("lifetime_gmv"),
                     F.sum("net_amount").alias("lifetime_net"),
                     F.sum("rating").alias("rating_sum"),
                     F.count("rating").alias("rating_n"))
                .withColumn("days_since_last", days_between("last_order_ts", F.lit(p.as_of))))
    return star.memo("customer_orders", build)


def lifecycle_bucket(star: Star) -> F.Column:
    p = star.params
    d = F.col("days_since_last")
    return F.when(d <= p.active_days, "1_active").when(d <= p.churn_days, "2_at_risk").otherwise("3_churned")


def lifecycle_snapshot(star: Star) -> DataFrame:
    b = (customer_orders(star).groupBy(lifecycle_bucket(star).alias("bucket"))
         .agg(F.count(F.lit(1)).alias("customers"), F.sum("lifetime_orders").alias("_o"),
              F.sum("lifetime_gmv").alias("lifetime_gmv_rs")))
    all_rows = Window.partitionBy()
    return b.select("bucket", "customers",
                    pct(F.col("customers"), F.sum("customers").over(all_rows)).alias("pct_of_ever_ordered"),
                    round_ratio("_o", "customers", 1).alias("avg_lifetime_orders"),
                    "lifetime_gmv_rs",
                    pct(F.col("lifetime_gmv_rs"), F.sum("lifetime_gmv_rs").over(all_rows)).alias("gmv_share_pct"))


def repeat_flags(star: Star) -> DataFrame:
    """Per customer with a first order: bad_first_experience and repeated (0/1).

    Orders are read once and reduced to (customer, day); a customer's list of days is bounded by the calendar.  The
    second order is strictly later than the first: on the same day, or on the next day with an order.
    """
    p = star.params
    days = orders_delivered(star).groupBy("customer_id", "order_date").agg(
        F.min(F.struct("order_ts", "order_id", "is_late_5plus", "items_missing")).alias("first"),
        F.max("order_ts").alias("last_ts"))
    per = days.groupBy("customer_id").agg(F.min(F.struct("order_date", "first", "last_ts")).alias("day"),
                                          F.sort_array(F.collect_list("order_date")).alias("days"))
    first = F.col("day.first")
    again = F.when(F.col("day.last_ts") > first["order_ts"], F.col("day.order_date")).otherwise(F.get("days", F.lit(1)))
    known = star.customer.filter(F.col("signup_ts") < ts_lit(p.as_of_end)).select("customer_id")
    return per.join(known, "customer_id").select(
        "customer_id", flag((first["is_late_5plus"] == 1) | (first["items_missing"] == 1)).alias("bad_first_experience"),
        flag(F.coalesce(F.datediff(again, "day.order_date") <= p.repeat_window_days, F.lit(False))).alias("repeated"))


def repeat_after_first_order(star: Star) -> DataFrame:
    """Second delivered order (strictly later timestamp) within the repeat window."""
    return (repeat_flags(star)
            .groupBy(first_experience().alias("first_experience"))
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("repeated").alias("_r"))
            .select("first_experience", "customers", pct("_r", "customers").alias("repeat_within_28d_pct")))


def churn_base(star: Star) -> DataFrame:
    """Customers with enough history (signup <= as-of - min history) and an order."""
    p = star.params
    cf = customer_first(star).filter(F.col("signup_ts") <= ts_lit(p.churn_signup_cutoff))
    lo = customer_orders(star).select("customer_id", "days_since_last")
    return (cf.join(lo, "customer_id")
            .withColumn("churned", F.when(F.col("days_since_last") > p.churn_days, 1).otherwise(0)))


def _churn_by(star: Star, *keys) -> DataFrame:
    out = (churn_base(star).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("customers"), F.sum("churned").alias("_c")))
    cols = [c for c in out.columns if c not in ("customers", "_c")]
    return out.select(*cols, "customers", pct("_c", "customers").alias("churn_rate_pct"))


def churn_by_first_experience(star: Star) -> DataFrame:
    return _churn_by(star, first_experience().alias("first_experience"))


def churn_by_channel(star: Star) -> DataFrame:
    return _churn_by(star, "acquisition_channel")


def churn_by_zone_period(star: Star) -> DataFrame:
    period = (F.when(F.col("cohort_month") >= F.lit(star.params.stress_start), "joined_may_onward")
              .otherwise("joined_before_may"))
    return _churn_by(star, zone_group("home_store_id", star).alias("zone_group"), period.alias("cohort_period"))


def reactivation(star: Star) -> DataFrame:
    """Share of 2+-order customers with a gap longer than the churn threshold.

    Gaps are measured in midnights, so only distinct order *days* matter: the
    log is first reduced to (customer, day) and the ``lag`` window then holds at
    most one row per calendar day of a customer's history.
    """
    p = star.params
    days = orders_delivered(star).groupBy("customer_id", "order_date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("customer_id").orderBy("order_date")
    gaps = days.withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)))
    per = (gaps.groupBy("customer_id").agg(F.sum("n").alias("orders"), F.max("gap").alias("max_gap"))
           .filter(F.col("orders") >= 2))
    return (per.agg(F.coalesce(F.sum(F.when(F.col("max_gap") > p.churn_days, 1).otherwise(0)), F.lit(0))
                    .cast("long").alias("reactivated_customers"),
                    F.count(F.lit(1)).alias("customers_with_2plus_orders"))
            .withColumn("reactivation_share_pct", pct("reactivated_customers", "customers_with_2plus_orders")))
