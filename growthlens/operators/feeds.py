"""BI feeds: persisted datasets at a useful grain.

The event log is pre-aggregated to month x platform x channel; cohort
retention keeps counts (not percentages) so any slice can recompute ratios.
``write_feeds`` persists all nine as parquet (full replace, idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_between_boundaries
from ..plans.base import (cohort_activity, customer_first, customer_spine, dim_date, flag, item_margin_by_order,
                          order_margin, orders_delivered, order_month_col, orders_as_of, session_funnel, stressed)
from ..config import Params
from ..plans.history import month_bits
from ..sources.star import Star, month_ranged
from .health import customer_health, product_health
from .marketplace import store_month_ops
from .order_parts import month_feed
from .rfm import customer_rfm


def feed_dim_date(star: Star) -> DataFrame:
    return dim_date(star)


def feed_dim_store(star: Star) -> DataFrame:
    return star.store.withColumn(
        "capacity_profile", F.when(stressed("store_id", star), "High demand growth").otherwise("Standard"))


def feed_dim_product(star: Star) -> DataFrame:
    ph = product_health(star).select("product_id", F.col("health_score").alias("product_health_score"),
                                     F.col("health_tier").alias("product_health_tier"))
    return star.product.join(ph, "product_id", "left")


def feed_dim_customer(star: Star) -> DataFrame:
    def build():
        cf = customer_first(star).select(
            "customer_id", "signup_date", "cohort_month", "acquisition_channel", "platform", "home_store_id",
            "activated_7d", "never_ordered", "bad_first_experience")
        r = customer_rfm(star).select("customer_id", "rfm_segment")
        h = customer_health(star).select("customer_id", F.col("health_tier").alias("customer_health_tier"),
                                         F.col("health_score").alias("customer_health_score"))
        return cf.join(r, "customer_id", "left").join(h, "customer_id", "left")
    return star.memo("feed_dim_customer", build)


def feed_fact_orders(star: Star) -> DataFrame:
    """All orders; delivered-only flags are 0 for cancelled, economics NULL."""
    return star.memo("feed_fact_orders", lambda: _fact_orders(star, True).drop("month"))


def fact_orders_by_month(star: Star, margin: bool = True) -> DataFrame:
    """``feed_fact_orders`` plus ``month``: the storage partition column when the
    star was read from month-partitioned parquet, so a month filter prunes
    whole directories of the orders scan.  Without ``margin`` the order lines are not read."""
    return star.memo(f"fact_orders_by_month_{margin}", lambda: _fact_orders(star, margin))


def _fact_orders(star: Star, margin: bool) -> DataFrame:
    o = orders_as_of(star)
    dlv = F.col("status") == "delivered"
    act, prom = F.col("actual_delivery_min"), F.col("promised_min")
    economics = ["item_margin", "contribution_rs"] if margin else []
    if margin:
        o = o.join(order_margin(star).select("order_id", *economics), "order_id", "left")
    return (o.select(order_month_col(o).alias("month"), "order_id", "customer_id", "store_id",
                    F.col("order_ts").cast("date").alias("order_date"), "status", "promised_min", "actual_delivery_min",
                    flag(dlv & (act <= prom)).alias("is_on_time"),
                    flag(dlv & (act > prom + star.params.late_tolerance_min)).alias("is_late_5plus"),
                    F.col("items_missing").cast("int").alias("items_missing"),
                    flag(dlv & (act <= prom) & (F.col("items_missing") == 0)).alias("is_perfect_order"),
                    "item_total", "discount_amount", "delivery_fee", "handling_fee", "net_amount",
                    "payment_method", "rating", *economics))


FUNNEL_STAGES = ["sessions", "searched", "reached_product_view", "reached_cart", "reached_checkout", "converted"]


def funnel_monthly(sessions: DataFrame, customers: DataFrame, periods: tuple[str, ...] = ("session_month",)) -> DataFrame:
    """Session rows (``session_funnel`` shape) -> month (or other ``periods``) x platform x channel stage counts.

    Counts are first summed per (customer, period, platform), so the join with
    the customer table sees a calendar-bounded number of rows per customer
    however many sessions one customer has.
    """
    c = customers.select("customer_id", "acquisition_channel")
    per_c = (sessions.groupBy("customer_id", *periods, "platform")
             .agg(F.count(F.lit(1)).alias("sessions"), F.sum("used_search").alias("searched"),
                  F.sum("reached_pv").alias("reached_product_view"), F.sum("reached_cart").alias("reached_cart"),
                  F.sum("reached_checkout").alias("reached_checkout"), F.sum("converted").alias("converted")))
    return (per_c.join(c, "customer_id")
            .groupBy(*periods, "platform", "acquisition_channel")
            .agg(*[F.sum(s).alias(s) for s in FUNNEL_STAGES]))


def feed_funnel_monthly(star: Star) -> DataFrame:
    return star.memo("feed_funnel_monthly", lambda: funnel_monthly(session_funnel(star), star.customer))


def feed_cohort_retention(star: Star) -> DataFrame:
    def build():
        size = customer_spine(star).groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
        act = (cohort_activity(star).groupBy("cohort_month", "month_offset")
               .agg(F.count(F.lit(1)).alias("active_customers")))  # one row per customer and offset
        return act.join(size, "cohort_month").select("cohort_month", "month_offset", "cohort_size",
                                                     "active_customers")
    return star.memo("feed_cohort_retention", build)


def cohort_grid(star: Star) -> DataFrame:
    """Every observable cohort x offset cell with its size and actives (0 where nobody was active)."""
    return star.memo("cohort_grid", lambda: grid_of_cohorts(customer_spine(star), feed_cohort_retention(star), star.params))


def grid_of_cohorts(customers: DataFrame, retention: DataFrame, params: Params) -> DataFrame:
    size = customers.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    lived = months_between_boundaries("cohort_month", F.lit(params.observation_month))
    cells = size.where(lived >= 0).select("cohort_month", "cohort_size", F.explode(
        F.sequence(F.lit(0).cast("long"), lived.cast("long"))).alias("month_offset"))
    act = retention.select("cohort_month", F.col("month_offset").cast("long").alias("month_offset"), "active_customers")
    return cells.join(act, ["cohort_month", "month_offset"], "left").select(
        "cohort_month", "month_offset", "cohort_size",
        F.coalesce("active_customers", F.lit(0)).alias("active_customers"))


def feed_order_month(star: Star) -> DataFrame:
    """Parts of the order measures by month, store, channel and platform, with bitmaps of the active customers."""
    return star.memo("feed_order_month", lambda: month_feed(
        fact_orders_by_month(star), customer_spine(star).select("customer_id", "acquisition_channel", "platform")))


def feed_customer_months(star: Star) -> DataFrame:
    """The active months of every customer as bit sets."""
    return star.memo("feed_customer_months", lambda: month_bits(orders_delivered(star)))


def feed_store_month_ops(star: Star) -> DataFrame:
    return store_month_ops(star)


def feed_marketing(star: Star) -> DataFrame:
    def build():
        c = (customer_first(star).groupBy(F.col("cohort_month").alias("month_start"),
                                          F.col("acquisition_channel").alias("channel"))
             .agg(F.count(F.lit(1)).alias("signups"), F.sum("activated_7d").alias("activated_7d")))
        return star.spend.join(c, ["month_start", "channel"], "left") \
            .select("month_start", "channel", "spend_inr", "signups", "activated_7d")
    return star.memo("feed_marketing", build)


FEEDS = {
    "feed_dim_date": feed_dim_date,
    "feed_dim_store": feed_dim_store,
    "feed_dim_product": feed_dim_product,
    "feed_dim_customer": feed_dim_customer,
    "feed_fact_orders": feed_fact_orders,
    "feed_funnel_monthly": feed_funnel_monthly,
    "feed_cohort_retention": feed_cohort_retention,
    "feed_store_month_ops": feed_store_month_ops,
    "feed_marketing": feed_marketing,
    "feed_order_month": feed_order_month,
    "feed_customer_months": feed_customer_months,
}

# Partition column per feed when written (month-grain facts prune by month).
_PARTITION = {"feed_funnel_monthly": "session_month", "feed_store_month_ops": "order_month",
              "feed_marketing": "month_start", "feed_order_month": "month"}
# Feeds that grow with orders inside a month: partition column, and the column that orders rows in it (``month_feed``
# deals its own rows so).
_RANGED = {"feed_fact_orders": ("order_month", "order_id")}


def feed_partition(name: str) -> str | None:
    """The month column a feed is written by, if any."""
    return _RANGED[name][0] if name in _RANGED else _PARTITION.get(name)


def write_feed(name: str, df: DataFrame, target: str, mode: str = "static") -> None:
    """``mode``: static replaces the whole feed, dynamic only the months that ``df`` has."""
    month = feed_partition(name)
    if name == "feed_fact_orders":
        df = df.withColumn("order_month", F.trunc("order_date", "month"))
    if name in _RANGED:
        df = month_ranged(df, *_RANGED[name])
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode)
    (writer.partitionBy(month) if month else writer).parquet(target)


def write_feeds(star: Star, path: str, names: list[str] | None = None) -> dict[str, str]:
    """Persist feeds as parquet under ``path`` (overwrite = full replace).

    ``feed_fact_orders`` is written partitioned by order month, so a dashboard
    reading one month touches one directory.
    """
    out = {}
    for name in names or list(FEEDS):
        out[name] = f"{path}/{name}"
        write_feed(name, FEEDS[name](star), out[name])
    return out


__all__ = list(FEEDS) + ["write_feeds", "item_margin_by_order"]
