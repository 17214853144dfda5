"""RFM segmentation.

Three quintile scores with an exact, distributed NTILE (ties broken by
customer id ascending, T8).  R is ranked on recency descending so the
freshest customers score 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import pct, round_ratio, rounded_units
from ..plans.base import customer_first
from ..plans.ntile import distributed_ntiles
from ..sources.star import Star
from .churn import customer_orders


def rfm_segment() -> F.Column:
    r, f = F.col("r_score"), F.col("f_score")
    return (F.when((r >= 4) & (f >= 4), "Champions")
             .when((r >= 3) & (f >= 4), "Loyal")
             .when((r >= 4) & (f == 3), "Potential Loyalist")
             .when((r >= 4) & (f <= 2), "New / Light")
             .when((r == 3) & (f <= 3), "Needs Attention")
             .when((r == 2) & (f >= 3), "At Risk")
             .when((r <= 1) & (f >= 4), "Cannot Lose Them")
             .when((r == 2) & (f <= 2), "Hibernating")
             .otherwise("Lost"))


def _scored(star: Star) -> DataFrame:
    base = customer_orders(star).select(
        "customer_id",
        F.col("days_since_last").alias("recency_days"),
        F.col("lifetime_orders").alias("frequency"),
        F.col("lifetime_net").alias("monetary_rs"),
        rounded_units("rating_sum", "rating_n", 6).alias("avg_rating_micro"))
    return distributed_ntiles(base, "customer_id", {
        "r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary_rs")}, 5,
        rows=star.customer)


def customer_rfm(star: Star) -> DataFrame:
    def build():
        s = _scored(star)
        return s.select(
            "customer_id", "recency_days", "frequency", "monetary_rs",
            (F.col("avg_rating_micro").cast("double") / F.lit(1e6)).alias("avg_rating"),
            "r_score", "f_score", "m_score",
            F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                     F.col("m_score").cast("string")).alias("rfm_cell"),
            rfm_segment().alias("rfm_segment"),
            "avg_rating_micro")
    return star.memo("customer_rfm", build)


def customer_rfm_public(star: Star) -> DataFrame:
    return customer_rfm(star).drop("avg_rating_micro")


def rfm_summary(star: Star) -> DataFrame:
    g = (customer_rfm(star).groupBy("rfm_segment")
         .agg(F.count(F.lit(1)).alias("customers"), F.sum("recency_days").alias("_rec"),
              F.sum("frequency").alias("_f"), F.sum("monetary_rs").alias("segment_net_spend_rs"),
              F.sum("avg_rating_micro").alias("_rs"), F.count("avg_rating_micro").alias("_rn")))
    all_rows = Window.partitionBy()
    return g.select(
        "rfm_segment", "customers",
        pct(F.col("customers"), F.sum("customers").over(all_rows)).alias("pct_of_base"),
        round_ratio("_rec", "customers", 0).alias("avg_recency_days"),
        round_ratio("_f", "customers", 1).alias("avg_orders"),
        round_ratio("segment_net_spend_rs", "customers", 0).alias("avg_net_spend_rs"),
        "segment_net_spend_rs",
        pct(F.col("segment_net_spend_rs"), F.sum("segment_net_spend_rs").over(all_rows)).alias("spend_share_pct"),
        round_ratio(F.col("_rs"), F.col("_rn") * 1_000_000, 2).alias("avg_rating"))


def rfm_bad_first(star: Star) -> DataFrame:
    cf = customer_first(star).select("customer_id", "bad_first_experience")
    return (customer_rfm(star).select("customer_id", "rfm_segment").join(cf, "customer_id")
            .groupBy("rfm_segment")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("bad_first_experience").alias("_b"))
            .select("rfm_segment", "customers", pct("_b", "customers").alias("pct_bad_first_experience")))
