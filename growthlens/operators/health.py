"""Customer and product health scores."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between, ts_lit
from ..functions.ratios import idiv, pct, round_ratio
from ..plans.base import items_since, orders_delivered, since, zone_group
from ..plans.ntile import distributed_ntiles
from ..sources.star import Star


def _band_points(value: F.Column, bands, op: str = ">=") -> F.Column:
    expr = None
    for limit, pts in bands:
        cond = value <= limit if op == "<=" else value >= limit
        expr = F.when(cond, pts) if expr is None else expr.when(cond, pts)
    return expr


def customer_health(star: Star) -> DataFrame:
    def build():
        p = star.params
        od = orders_delivered(star)
        ts = F.col("order_ts")
        w_start = ts_lit(p.days_before_as_of(p.health_window_days))
        t_start = ts_lit(p.days_before_as_of(p.health_trend_days))
        e_start = ts_lit(p.days_before_as_of(p.health_experience_days))
        in_w = ts >= w_start
        b = (od.groupBy("customer_id")
             .agg(F.max("order_ts").alias("_last"),
                  F.sum(F.when(in_w, 1).otherwise(0)).alias("orders_56d"),
                  F.sum(F.when(in_w, F.col("net_amount")).otherwise(0)).alias("spend_56d"),
                  F.sum(F.when(ts >= t_start, 1).otherwise(0)).alias("orders_last28"),
                  F.sum(F.when(in_w & (ts < t_start), 1).otherwise(0)).alias("orders_prior28"),
                  F.sum(F.when(ts >= e_start, F.col("is_perfect_order"))).alias("_perf"),
                  F.count(F.when(ts >= e_start, 1)).alias("_n90"))
             .join(star.customer.select("customer_id"), "customer_id")
             .withColumn("recency_days", days_between("_last", F.lit(p.as_of))))
        rec = F.coalesce(_band_points(F.col("recency_days"), p.recency_bands, "<="), F.lit(0))
        frq = F.coalesce(_band_points(F.col("orders_56d"), p.orders_bands), F.lit(0))
        spend = F.col("spend_56d")
        mon = F.coalesce(_band_points(spend, p.spend_bands), F.when(spend > 0, p.spend_floor_points), F.lit(0))
        perf100 = F.col("_perf") * 100
        exp_bands = [(lim, pts) for lim, pts in p.perfect_bands_pct]
        exp = F.lit(0)
        for lim, pts in reversed(exp_bands):
            exp = F.when((F.col("_n90") > 0) & (perf100 >= F.col("_n90") * lim), pts).otherwise(exp)
        l28, p28 = F.col("orders_last28"), F.col("orders_prior28")
        trend = (F.when(l28 > p28, 10).when((l28 == p28) & (l28 > 0), 6).when(l28 < p28, 2).otherwise(0))
        score = (rec + frq + mon + exp + trend).cast("int")
        s = F.col("health_score")
        tier = (F.when(s >= 75, "1_Healthy").when(s >= 50, "2_Stable").when(s >= 25, "3_At_Risk")
                .otherwise("4_Critical"))
        return (b.withColumn("health_score", score)
                .select("customer_id", "recency_days", "orders_56d", "spend_56d", "orders_last28",
                        "orders_prior28", "health_score", tier.alias("health_tier")))
    return star.memo("customer_health", build)


def health_tier_summary(star: Star) -> DataFrame:
    g = (customer_health(star).groupBy("health_tier")
         .agg(F.count(F.lit(1)).alias("customers"), F.sum("health_score").alias("_s"),
              F.sum("spend_56d").alias("spend_56d_rs")))
    allr = Window.partitionBy()
    return g.select("health_tier", "customers",
                    pct(F.col("customers"), F.sum("customers").over(allr)).alias("pct_of_base"),
                    round_ratio("_s", "customers", 1).alias("avg_score"),
                    "spend_56d_rs",
                    pct(F.col("spend_56d_rs"), F.sum("spend_56d_rs").over(allr)).alias("spend_share_pct"))


def health_by_zone(star: Star) -> DataFrame:
    c = star.customer.select("customer_id", "home_store_id")
    g = (customer_health(star).join(c, "customer_id")
         .groupBy(zone_group("home_store_id", star).alias("zone_group"), "health_tier")
         .agg(F.count(F.lit(1)).alias("customers")))
    return g.withColumn("pct_within_zone",
                        pct(F.col("customers"), F.sum("customers").over(Window.partitionBy("zone_group"))))


def product_health(star: Star) -> DataFrame:
    def build():
        p = star.params
        od = (since(orders_delivered(star), p.days_before_as_of(p.product_window_days))
              .select("order_id", "customer_id", "order_date"))
        prod = star.product
        first_day = p.days_before_as_of(p.product_window_days)
        # weeks with a sale as bits of one bigint for 64 weeks of the window: an OR, where a distinct count would expand
        # every line
        week = F.floor(F.datediff("order_date", F.lit(first_day - _dt.timedelta(days=first_day.weekday()))) / 7)
        words = range((p.product_window_days + 14) // (7 * 64) + 1)
        bits = [F.bit_or(F.when(F.floor(week / 64) == k, F.call_function(
            "shiftleft", F.lit(1).cast("long"), (week % 64).cast("int")))).alias(f"_w{k}") for k in words]
        # per-product sums first (unit_cost is fixed per product: margin = sum(line) - cost * sum(qty)),
        # then a product-level join: a SKU with a huge share of lines is never a join key on line rows
        sales = (items_since(star, first_day).join(od, "order_id")
                 .groupBy("product_id")
                 .agg(F.sum("quantity").alias("_u"), F.sum("line_amount").alias("_g"),
                      F.countDistinct("customer_id").alias("_b"), *bits)
                 .withColumn("_w", sum(F.coalesce(F.bit_count(f"_w{k}"), F.lit(0)) for k in words).cast("long")))
        zero = F.lit(0).cast("long")
        base = (prod.select("product_id", "product_name", "category", "is_private_label", "unit_cost")
                .join(sales, "product_id", "left")
                .withColumn("_m", F.col("_g") - F.col("_u") * F.col("unit_cost"))
                .select("product_id", "product_name", "category", "is_private_label",
                        F.coalesce("_u", zero).alias("units_56d"),
                        F.coalesce("_g", zero).alias("gmv_56d"),
                        F.coalesce("_b", zero).alias("buyers_56d"),
                        pct("_m", "_g").alias("margin_pct"),
                        F.least(F.coalesce("_w", zero), F.lit(p.product_max_weeks).cast("long"))
                        .alias("weeks_sold_of_8"),
                        F.coalesce(F.col("_m").cast("double") / F.nullif(F.col("_g"), F.lit(0)).cast("double"),
                                   F.lit(0.0)).alias("_mrate")))
        s = distributed_ntiles(base, "product_id", {
            "_nu": F.col("units_56d"), "_ng": F.col("gmv_56d"), "_nm": F.col("_mrate"), "_nb": F.col("buyers_56d")}, 5,
            rows=prod)
        score = (5 * F.col("_nu") + 4 * F.col("_ng") + 4 * F.col("_nm") + 4 * F.col("_nb")
                 + idiv(F.col("weeks_sold_of_8") * 15, F.lit(p.product_max_weeks))).cast("int")
        hs = F.col("health_score")
        tier = F.when(hs >= 80, "1_Star").when(hs >= 60, "2_Solid").when(hs >= 40, "3_Watch").otherwise("4_Review")
        return (s.withColumn("health_score", score)
                .select("product_id", "product_name", "category", "is_private_label", "units_56d", "gmv_56d",
                        "buyers_56d", "margin_pct", "weeks_sold_of_8", "health_score",
                        tier.alias("health_tier")))
    return star.memo("product_health", build)


def product_tier_mix(star: Star) -> DataFrame:
    t = F.col("health_tier")

    def n(label):
        return F.sum(F.when(t == label, 1).otherwise(0)).cast("long")

    return (product_health(star).groupBy("category")
            .agg(n("1_Star").alias("star"), n("2_Solid").alias("solid"), n("3_Watch").alias("watch"),
                 n("4_Review").alias("review")))


def product_review_list(star: Star, k: int = 20) -> DataFrame:
    """The k weakest products; a distributed top-k (TakeOrderedAndProject)."""
    return (product_health(star)
            .orderBy(F.col("health_score").asc(), F.col("units_56d").asc(), F.col("product_id").asc())
            .limit(k)
            .select("product_id", "product_name", "category", "health_score", "units_56d", "buyers_56d",
                    "margin_pct"))
