"""Marketplace / store operations health."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.ratios import pct, round_ratio, rounded_units
from ..plans.base import orders_as_of, orders_delivered
from ..sources.star import Star


def _store_month_units(star: Star) -> DataFrame:
    """Store x month over all orders; percentages kept as integer tenths."""
    def build():
        o = orders_as_of(star)
        dlv = F.col("status") == "delivered"
        act, prom = F.col("actual_delivery_min"), F.col("promised_min")
        stores = star.store.select("store_id", "zone_name")  # one row per store
        g = (o.groupBy("store_id", month_start("order_ts").alias("order_month"))
             .agg(F.count(F.lit(1)).alias("orders_placed"),
                  F.sum(F.when(F.col("status") == "cancelled", 1).otherwise(0)).alias("cancelled"),
                  F.sum(F.when(dlv, act)).alias("_dsum"), F.count(F.when(dlv, act)).alias("_dn"),
                  F.count(F.when(dlv, 1)).alias("_deliv"),
                  F.sum(F.when(dlv & (act <= prom), 1).otherwise(0)).alias("_ontime"),
                  F.sum(F.when(dlv & (act > prom + star.params.late_tolerance_min), 1).otherwise(0)).alias("_late"),
                  F.sum(F.when(dlv, F.col("items_missing")).otherwise(0)).alias("_miss"),
                  F.sum(F.when(dlv & (act <= prom) & (F.col("items_missing") == 0), 1).otherwise(0)).alias("_perf"),
                  F.sum("rating").alias("_rsum"), F.count("rating").alias("_rn")))
        return (g.join(F.broadcast(stores), "store_id")
                .withColumn("on_time_tenths", rounded_units("_ontime", "_deliv", 1, 100))
                .withColumn("rating_hundredths", rounded_units("_rsum", "_rn", 2)))
    return star.memo("store_month_units", build)


def store_month_ops(star: Star) -> DataFrame:
    u = _store_month_units(star)
    return u.select(
        "store_id", "zone_name", "order_month", "orders_placed", "cancelled",
        pct("cancelled", "orders_placed").alias("cancel_pct"),
        round_ratio("_dsum", "_dn", 1).alias("avg_delivery_min"),
        (F.col("on_time_tenths").cast("double") / F.lit(10.0)).alias("on_time_pct"),
        pct("_late", "_deliv").alias("late_5plus_pct"),
        pct("_miss", "_deliv").alias("items_missing_pct"),
        pct("_perf", "_deliv").alias("perfect_order_pct"),
        (F.col("rating_hundredths").cast("double") / F.lit(100.0)).alias("avg_rating"))


def store_pre_post(star: Star) -> DataFrame:
    """Unweighted mean of the rounded monthly values before/after the stress start."""
    u = _store_month_units(star)
    pre = F.col("order_month") < F.lit(star.params.stress_start)
    g = u.groupBy("store_id", "zone_name").agg(
        F.sum(F.when(pre, F.col("on_time_tenths"))).alias("t0"), F.count(F.when(pre, F.col("on_time_tenths"))).alias("n0"),
        F.sum(F.when(~pre, F.col("on_time_tenths"))).alias("t1"), F.count(F.when(~pre, F.col("on_time_tenths"))).alias("n1"),
        F.sum(F.when(pre, F.col("rating_hundredths"))).alias("r0"),
        F.count(F.when(pre, F.col("rating_hundredths"))).alias("rn0"),
        F.sum(F.when(~pre, F.col("rating_hundredths"))).alias("r1"),
        F.count(F.when(~pre, F.col("rating_hundredths"))).alias("rn1"))
    t0, n0, t1, n1 = (F.col(c).cast("decimal(38,0)") for c in ("t0", "n0", "t1", "n1"))
    return g.select(
        "store_id", "zone_name",
        round_ratio("t0", F.col("n0") * 10, 1).alias("on_time_pre_may"),
        round_ratio("t1", F.col("n1") * 10, 1).alias("on_time_post_may"),
        round_ratio(t1 * n0 - t0 * n1, n1 * n0 * 10, 1).alias("on_time_delta_pp"),
        round_ratio("r0", F.col("rn0") * 100, 2).alias("rating_pre_may"),
        round_ratio("r1", F.col("rn1") * 100, 2).alias("rating_post_may"))


def demand_heatmap(star: Star) -> DataFrame:
    """Orders (all statuses) by weekday x hour."""
    o = orders_as_of(star)
    d = F.col("order_ts").cast("date")
    g = (o.groupBy(F.weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
                   F.hour("order_ts").alias("hour_of_day"))
         .agg(F.count(F.lit(1)).alias("orders")))
    return g.withColumn("pct_of_orders", pct(F.col("orders"), F.sum("orders").over(Window.partitionBy()), 2))


def repeat_vs_on_time(star: Star) -> DataFrame:
    """Store-month on-time vs share of its customers ordering next calendar month."""
    p = star.params
    last_month = _dt.date(p.as_of.year, p.as_of.month, 1)
    od = orders_delivered(star)
    smc = od.select("store_id", "order_month", "customer_id").distinct() \
        .filter(F.col("order_month") < F.lit(last_month))
    nxt = (od.select("customer_id", F.add_months("order_month", -1).alias("order_month")).distinct()
           .withColumn("repeated", F.lit(1)))
    nmr = (smc.join(nxt, ["customer_id", "order_month"], "left")
           .groupBy("store_id", "order_month")
           .agg(F.count(F.lit(1)).alias("customers"), F.sum(F.coalesce("repeated", F.lit(0))).alias("_r")))
    ops = store_month_ops(star).select("store_id", "zone_name", "order_month", "on_time_pct")
    return (nmr.join(ops, ["store_id", "order_month"])
            .select("store_id", "zone_name", "order_month", "on_time_pct",
                    pct("_r", "customers").alias("next_month_repeat_pct")))
