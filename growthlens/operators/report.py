"""Report metrics quoted in the analysis write-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import months_between_boundaries, ts_lit
from ..functions.ratios import DEC, pct, round_ratio
from ..plans.base import (customer_first, customer_spine, order_margin, orders_as_of, orders_delivered,
                          session_funnel, since, zone_group)
from ..sources.star import Star
from .churn import repeat_flags
from .experience import _reorder_flags
from .gmv import tenure_bucket
from .health import customer_health
from .retention import _cohort_cells, buyer_type, discount_profile
from .rfm import customer_rfm


def bad_first_share(star: Star) -> DataFrame:
    cf = customer_first(star).filter(F.col("first_order_ts").isNotNull())
    return (cf.agg(F.count(F.lit(1)).alias("customers_with_first_order"),
                   F.sum("bad_first_experience").alias("bad_first_orders"))
            .withColumn("bad_first_pct", pct("bad_first_orders", "customers_with_first_order")))


def same_day_share_of_buyers(star: Star) -> DataFrame:
    cf = customer_first(star).filter(F.col("never_ordered") == 0)
    return (cf.agg(F.count(F.lit(1)).alias("buyers"),
                   F.sum(F.when(F.col("days_to_first_order") < 1, 1).otherwise(0)).cast("long").alias("same_day"))
            .withColumn("same_day_pct_of_buyers", pct("same_day", "buyers")))


def ops_pooled_stressed_vs_other(star: Star) -> DataFrame:
    """Store ops pooled over all orders since the stress start, by store zone group."""
    p = star.params
    o = since(orders_as_of(star), p.stress_start)
    dlv = F.col("status") == "delivered"
    act, prom = F.col("actual_delivery_min"), F.col("promised_min")
    g = o.groupBy(zone_group("store_id", star).alias("zone_group")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count(F.when(dlv, 1)).alias("_d"),
        F.sum(F.when(dlv & (act <= prom), 1).otherwise(0)).alias("_on"),
        F.sum(F.when(dlv & (act > prom + p.late_tolerance_min), 1).otherwise(0)).alias("_late"),
        F.sum(F.when(dlv, F.col("items_missing")).otherwise(0)).alias("_miss"),
        F.sum(F.when(~dlv, 1).otherwise(0)).alias("_canc"),
        F.sum("rating").alias("_rs"), F.count("rating").alias("_rn"))
    return g.select("zone_group", "orders", pct("_on", "_d").alias("on_time_pct"),
                    pct("_late", "_d").alias("late_5plus_pct"), pct("_miss", "_d").alias("items_missing_pct"),
                    pct("_canc", "orders").alias("cancel_pct"), round_ratio("_rs", "_rn", 2).alias("avg_rating"))


def zone_unhealthy_share(star: Star) -> DataFrame:
    c = star.customer.select("customer_id", "home_store_id")
    bad = F.col("health_tier").isin("3_At_Risk", "4_Critical")
    return (customer_health(star).join(c, "customer_id")
            .groupBy(zone_group("home_store_id", star).alias("zone_group"))
            .agg(F.count(F.lit(1)).alias("customers"), F.sum(F.when(bad, 1).otherwise(0)).alias("_u"))
            .select("zone_group", "customers", pct("_u", "customers").alias("unhealthy_pct")))


def discount_led_share(star: Star) -> DataFrame:
    p = star.params
    cf = (customer_first(star).filter(F.col("cohort_month") <= F.lit(p.last_full_m1_cohort))
          .select("customer_id", "cohort_month"))
    group = F.when(F.col("cohort_month") == F.lit(p.promo_cohort), "may_2026").otherwise("other_cohorts")
    return (cf.join(discount_profile(star), "customer_id")
            .groupBy(group.alias("cohort_group"))
            .agg(F.count(F.lit(1)).alias("buyers"),
                 F.sum(F.when(buyer_type(star) == "discount_led", 1).otherwise(0)).alias("_d"))
            .select("cohort_group", "buyers", pct("_d", "buyers").alias("discount_led_pct")))


def blended_retention(star: Star) -> DataFrame:
    """M1/M3/M6 pooled over observable cohorts: sum of actives / sum of sizes."""
    cells = _cohort_cells(star, [1, 3, 6])
    aggs = []
    for k in (1, 3, 6):
        ok = F.col("max_offset") >= k
        aggs += [F.sum(F.when(ok, F.coalesce(F.col(f"a{k}"), F.lit(0)))).alias(f"_a{k}"),
                 F.sum(F.when(ok, F.col("cohort_size"))).alias(f"_s{k}")]
    g = cells.agg(*aggs)
    return g.select(*[pct(f"_a{k}", f"_s{k}").alias(f"m{k}_pct") for k in (1, 3, 6)])


def search_share(star: Star) -> DataFrame:
    return (session_funnel(star).agg(F.count(F.lit(1)).alias("sessions"), F.sum("used_search").alias("searched"))
            .withColumn("search_share_pct", pct("searched", "sessions")))


def top_segments_share(star: Star) -> DataFrame:
    r = customer_rfm(star)
    top = F.col("rfm_segment").isin("Champions", "Loyal")
    g = r.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(top, 1).otherwise(0)).alias("customers"),
              F.sum("monetary_rs").alias("_m"), F.sum(F.when(top, F.col("monetary_rs")).otherwise(0)).alias("_tm"))
    return g.select("customers", pct("customers", "_n").alias("pct_of_base"),
                    pct("_tm", "_m").alias("spend_share_pct"))


def reorder_low_rating(star: Star) -> DataFrame:
    # pooled from the per-order flags, not from the rounded per-rating shares
    f = _reorder_flags(star).filter(F.col("rating") <= 2)
    return (f.agg(F.count(F.lit(1)).alias("rated_orders"), F.sum("reordered").alias("_re"))
            .select("rated_orders", pct("_re", "rated_orders").alias("pct_reordered_within_30d")))


def avg_contribution_per_order(star: Star) -> DataFrame:
    return (order_margin(star).agg(F.count(F.lit(1)).alias("orders"), F.sum("contribution_rs").alias("_c"))
            .select("orders", round_ratio("_c", "orders", 0).alias("avg_contribution_per_order_rs")))


def high_margin_categories(star: Star) -> DataFrame:
    """Categories whose item margin rate is at least the overall rate (delivered orders)."""
    od = orders_delivered(star).select("order_id")
    prod = star.product.select("product_id", "category", "unit_cost")
    # per-product sums before the product join (margin = sum(line) - unit_cost * sum(qty))
    per_p = (star.items.join(od, "order_id").groupBy("product_id")
             .agg(F.sum("line_amount").alias("_g"), F.sum("quantity").alias("_q")))
    cat = (per_p.join(prod, "product_id").groupBy("category")
           .agg(F.sum(F.col("_g") - F.col("_q") * F.col("unit_cost")).alias("m"), F.sum("_g").alias("g")))
    # totals as a window over the category-level rows (one row per category)
    allc = Window.partitionBy()
    tm, tg = F.sum("m").over(allc).cast(DEC), F.sum("g").over(allc).cast(DEC)
    return (cat.withColumn("_keep", F.col("m").cast(DEC) * tg >= tm * F.col("g").cast(DEC))
            .filter("_keep").select("category"))


def high_margin_attach(star: Star) -> DataFrame:
    """Share of delivered orders with at least one high-margin-category line, by tenure."""
    hm = high_margin_categories(star).withColumn("_hm", F.lit(1))
    # products of those categories (product-level), then the line join of plain scans: AQE splits the lines of a hot SKU
    hm_products = star.product.select("product_id", "category").join(F.broadcast(hm), "category") \
        .select("product_id")
    attach = (star.dealt("items", star.items.select("order_id", "product_id").join(hm_products, "product_id")
                         .select("order_id"), "order_id")
              .distinct().withColumn("_att", F.lit(1)))
    od = orders_delivered(star).select("order_id", "customer_id", "order_month")
    # flag on the order key, then (customer, month) partial sums before the customer join
    per_cm = (od.join(attach, "order_id", "left")
              .groupBy("customer_id", "order_month")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("_att", F.lit(0))).alias("_a")))
    cf = customer_spine(star).select("customer_id", "cohort_month")
    off = months_between_boundaries("cohort_month", "order_month")
    return (per_cm.join(cf, "customer_id")
            .groupBy(tenure_bucket(off).alias("tenure_bucket"))
            .agg(F.sum("_n").alias("orders"), F.sum("_a").alias("_a"))
            .select("tenure_bucket", "orders", pct("_a", "orders").alias("high_margin_attach_pct")))


def bad_first_opportunity(star: Star) -> DataFrame:
    """Half of the bad-first customers times the repeat-rate lift of a good first order."""
    f = repeat_flags(star)
    g = f.agg(F.sum(F.when(F.col("bad_first_experience") == 1, 1).otherwise(0)).alias("bad_first_customers"),
              F.sum(F.when(F.col("bad_first_experience") == 1, F.col("repeated")).otherwise(0)).alias("_rb"),
              F.sum(F.when(F.col("bad_first_experience") == 0, 1).otherwise(0)).alias("_ng"),
              F.sum(F.when(F.col("bad_first_experience") == 0, F.col("repeated")).otherwise(0)).alias("_rg"))
    nb, rb, ng, rg = (F.col(c).cast(DEC) for c in ("bad_first_customers", "_rb", "_ng", "_rg"))
    return g.select("bad_first_customers",
                    pct("_rg", "_ng").alias("repeat_good_pct"),
                    pct("_rb", "bad_first_customers").alias("repeat_bad_pct"),
                    round_ratio(nb * rg - rb * ng, ng * 2, 0).alias("recoverable_customers"))
