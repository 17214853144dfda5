"""Base views every analysis module reuses.

``orders_delivered``, ``customer_first``, ``order_margin`` (SURVEY 2.3) plus
``session_funnel`` and ``cohort_activity``.  All are lazy; each is memoised on
the ``Star`` so a query that needs one twice shares the same plan subtree
(Spark then reuses the exchange).

Scale notes
* "First order per customer" is a partial aggregate (``min`` of a struct)
  instead of ``row_number`` over a customer window: a customer holding a third
  of all orders is then combined map-side instead of being sorted in one task.
* ``cohort_activity`` de-duplicates (customer, month) *before* the join with
  the customer spine.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import (hours_between_boundaries, month_start, months_between_boundaries,
                               seconds_between, ts_lit)
from ..sources.calendar import dim_date as _dim_date
from ..sources.star import Star
from .history import active_months


def flag(cond) -> F.Column:
    return F.when(cond, 1).otherwise(0)


def dim_date(star: Star) -> DataFrame:
    return star.memo("dim_date", lambda: _dim_date([
        (star.orders, "order_ts"), (star.customer, "signup_ts"), (star.events, "event_ts"), (star.spend, "month_start")]))


def orders_as_of(star: Star) -> DataFrame:
    """Orders of any status up to the as-of day; the one bound that every order metric shares."""
    p = star.params
    last_month = _dt.date(p.as_of.year, p.as_of.month, 1)
    return star.orders.filter((F.col("order_ts") < ts_lit(p.as_of_end))
                              & (order_month_col(star.orders) <= F.lit(last_month)))


def order_month_col(df: DataFrame) -> F.Column:
    """Order month: the storage partition column when the star was read from
    month-partitioned parquet (predicates on it prune directories), else derived."""
    return F.col("order_month") if "order_month" in df.columns else month_start("order_ts")


def since(df: DataFrame, day, col: str = "order_ts") -> DataFrame:
    """Rows with ``col`` >= midnight of ``day``, plus the implied month predicate
    so month-partitioned storage skips older months entirely."""
    first = _dt.date(day.year, day.month, 1)
    return df.filter((F.col(col) >= ts_lit(day)) & (order_month_col(df) >= F.lit(first)))


def items_since(star: Star, day) -> DataFrame:
    """Order lines that can belong to an order on or after ``day``: whole older months are pruned where the storage
    tells a line's month (lines without an order have none), else all lines."""
    first = _dt.date(day.year, day.month, 1)
    stored = star.by_month.get("items")
    return star.items if stored is None else stored.filter(F.col("order_month") >= F.lit(first)).drop("order_month")


def events_as_of(star: Star) -> DataFrame:
    """App events up to the as-of day; later months are pruned where the storage tells an event's month."""
    p = star.params
    stored = star.by_month.get("events")
    events = star.events if stored is None else stored.filter(
        F.col("event_month") <= F.lit(_dt.date(p.as_of.year, p.as_of.month, 1))).drop("event_month")
    return events.filter(F.col("event_ts") < ts_lit(p.as_of_end))


def _orders_delivered(star: Star) -> DataFrame:
    p = star.params
    o = orders_as_of(star)
    act, prom = F.col("actual_delivery_min"), F.col("promised_min")
    month = order_month_col(o)
    return (o.filter(F.col("status") == "delivered")
            .select("order_id", "customer_id", "store_id", "order_ts",
                    F.col("order_ts").cast("date").alias("order_date"),
                    month.alias("order_month"),
                    "promised_min", "actual_delivery_min",
                    F.when(act > prom, act - prom).otherwise(F.lit(0).cast("long")).alias("late_by_min"),
                    flag(act <= prom).alias("is_on_time"),
                    flag(act > prom + p.late_tolerance_min).alias("is_late_5plus"),
                    F.col("items_missing").cast("int").alias("items_missing"),
                    flag((act <= prom) & (F.col("items_missing") == 0)).alias("is_perfect_order"),
                    "item_total", "discount_amount", "delivery_fee", "handling_fee", "net_amount",
                    "payment_method", "rating"))


def orders_delivered(star: Star) -> DataFrame:
    return star.memo("orders_delivered", lambda: _orders_delivered(star))


def first_orders(star: Star) -> DataFrame:
    """One row per ordering customer: their first delivered order by (ts, id)."""
    def build():
        od = orders_delivered(star)
        first = F.min(F.struct("order_ts", "order_id", "store_id", "is_late_5plus", "items_missing",
                               "late_by_min")).alias("f")
        return (od.groupBy("customer_id").agg(first)
                  .select("customer_id",
                          F.col("f.order_ts").alias("first_order_ts"),
                          F.col("f.order_id").alias("first_order_id"),
                          F.col("f.store_id").alias("first_store_id"),
                          F.col("f.is_late_5plus").alias("first_late_5plus"),
                          F.col("f.items_missing").alias("first_items_missing"),
                          F.col("f.late_by_min").alias("first_late_by_min")))
    return star.memo("first_orders", build)


def orders_delivered_flagged(star: Star) -> DataFrame:
    """``orders_delivered`` plus ``is_first_order``.

    The flag comes from joining the first-order ids back on ``order_id`` (a
    uniformly spread key) rather than from a per-customer window.
    """
    firsts = first_orders(star).select(F.col("first_order_id").alias("order_id"),
                                       F.lit(1).alias("is_first_order"))
    return (orders_delivered(star).join(firsts, "order_id", "left")
            .withColumn("is_first_order", F.coalesce(F.col("is_first_order"), F.lit(0))))


def customer_spine(star: Star) -> DataFrame:
    """The customers who signed up by the as-of day, with their cohort month: all that cohort sizes need."""
    return star.memo("customer_spine", lambda: star.customer.filter(F.col("signup_ts") < ts_lit(star.params.as_of_end))
                     .withColumn("cohort_month", month_start("signup_ts")))


def _customer_first(star: Star) -> DataFrame:
    p = star.params
    f = first_orders(star)
    c = customer_spine(star)
    fo, su = F.col("first_order_ts"), F.col("signup_ts")
    return (c.join(f, "customer_id", "left")
            .select("customer_id", "signup_ts",
                    su.cast("date").alias("signup_date"),
                    "cohort_month", "acquisition_channel", "platform", "home_store_id",
                    "first_order_ts", "first_store_id",
                    (hours_between_boundaries(su, fo).cast("double") / F.lit(24.0)).alias("days_to_first_order"),
                    flag(fo.isNotNull() & (seconds_between(su, fo) <= p.activation_days * 86400)).alias("activated_7d"),
                    flag(fo.isNull()).alias("never_ordered"),
                    flag((F.col("first_late_5plus") == 1) | (F.col("first_items_missing") == 1)).alias("bad_first_experience")))


def customer_first(star: Star) -> DataFrame:
    return star.memo("customer_first", lambda: _customer_first(star))


def item_margin_by_order(star: Star) -> DataFrame:
    def build():
        prod = star.product.select("product_id", "unit_cost")
        # both sides are plain scans: adaptive execution splits the lines of a hot SKU, and the lines are read once
        return (star.items.join(prod, "product_id")
                .groupBy("order_id")
                .agg(F.sum(F.col("line_amount") - F.col("quantity") * F.col("unit_cost")).alias("item_margin")))
    return star.memo("item_margin_by_order", build)


def _order_margin(star: Star) -> DataFrame:
    p = star.params
    od = orders_delivered(star)
    fees = F.col("delivery_fee") + F.col("handling_fee")
    return (od.join(item_margin_by_order(star), "order_id")
            .select("order_id", "customer_id", "store_id", "order_month", "order_ts", "item_total",
                    "item_margin", "discount_amount", fees.alias("fees_collected"),
                    (F.col("item_margin") + fees - F.col("discount_amount") - p.last_mile_cost)
                    .alias("contribution_rs")))


def order_margin(star: Star) -> DataFrame:
    return star.memo("order_margin", lambda: _order_margin(star))


def _session_funnel(star: Star) -> DataFrame:
    e = events_as_of(star)
    name = F.col("event_name")

    def reached(n):
        return F.max(flag(name == n)).alias

    return (e.groupBy("session_id", "customer_id")
            .agg(F.min("event_ts").alias("session_start"),
                 F.max("platform").alias("platform"),
                 reached("search")("used_search"),
                 reached("product_view")("reached_pv"),
                 reached("add_to_cart")("reached_cart"),
                 reached("checkout_start")("reached_checkout"),
                 reached("payment_success")("converted"),
                 F.max(F.when(name == "payment_success", F.col("event_ts"))).alias("payment_ts"))
            .select("session_id", "customer_id", "session_start",
                    month_start("session_start").alias("session_month"),
                    "platform", "used_search", "reached_pv", "reached_cart", "reached_checkout",
                    "converted", "payment_ts"))


def session_funnel(star: Star) -> DataFrame:
    return star.memo("session_funnel", lambda: _session_funnel(star))


def _cohort_activity(star: Star) -> DataFrame:
    months = (orders_delivered(star).select("customer_id", "order_month").distinct() if star.history is None
              else active_months(star.history))
    spine = customer_spine(star).select("customer_id", "cohort_month", "acquisition_channel")
    return (months.join(spine, "customer_id")
            .select("customer_id", "cohort_month", "acquisition_channel",
                    months_between_boundaries("cohort_month", "order_month").alias("month_offset")))


def cohort_activity(star: Star) -> DataFrame:
    return star.memo("cohort_activity", lambda: _cohort_activity(star))


def stressed(col, star: Star) -> F.Column:
    return F.col(col).isin(list(star.params.stressed_stores)) if isinstance(col, str) else \
        col.isin(list(star.params.stressed_stores))


def zone_group(col: str, star: Star) -> F.Column:
    return F.when(stressed(col, star), "stressed_zone").otherwise("other_zones")
