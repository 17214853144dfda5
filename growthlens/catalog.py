"""Registry of every named dataset: name -> function(Star) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import feeds, measures, quality, report
from .operators import acquisition, activation, churn, experience, funnel, gmv, health, marketplace, retention, rfm
from .operators.order_parts import with_counts
from .plans import base
from .sources.star import Star, load_row_counts


def _od_flagged(star: Star) -> DataFrame:
    return base.orders_delivered_flagged(star)


QUERIES: dict[str, Callable[[Star], DataFrame]] = {
    # 2.1 sources / generated dimension
    "load_row_counts": load_row_counts,
    "dim_date": base.dim_date,
    # 2.2 data quality
    "dq_audit": quality.dq_audit,
    "dq_key_integrity": quality.dq_key_integrity,
    "order_status_profile": quality.order_status_profile,
    # 2.3 base views
    "orders_delivered": _od_flagged,
    "customer_first": base.customer_first,
    "order_margin": base.order_margin,
    # 2.4 acquisition
    "signups_by_month_channel": acquisition.signups_by_month_channel,
    "cac_by_channel": acquisition.cac_by_channel,
    "cac_payback": acquisition.cac_payback,
    "payback_month_by_channel": acquisition.payback_month_by_channel,
    "channel_scorecard": acquisition.channel_scorecard,
    # 2.5 activation
    "activation_by_month_channel": activation.activation_by_month_channel,
    "activation_by_platform": activation.activation_by_platform,
    "time_to_first_order": activation.time_to_first_order,
    "first_session_depth": activation.first_session_depth,
    # 2.6 funnel
    "session_funnel": base.session_funnel,
    "funnel_overall": funnel.funnel_overall,
    "conversion_by_month": funnel.conversion_by_month,
    "funnel_by_platform": funnel.funnel_by_platform,
    "search_vs_browse": funnel.search_vs_browse,
    "cart_checkout_by_zone_period": funnel.cart_checkout_by_zone_period,
    # 2.7 retention
    "cohort_activity": base.cohort_activity,
    "retention_triangle": retention.retention_triangle,
    "retention_m1_m3_m6": retention.retention_m1_m3_m6,
    "m1_by_channel": retention.m1_by_channel,
    "m1_by_buyer_type": retention.m1_by_buyer_type,
    # 2.8 churn
    "lifecycle_snapshot": churn.lifecycle_snapshot,
    "repeat_after_first_order": churn.repeat_after_first_order,
    "churn_by_first_experience": churn.churn_by_first_experience,
    "churn_by_channel": churn.churn_by_channel,
    "churn_by_zone_period": churn.churn_by_zone_period,
    "reactivation": churn.reactivation,
    # 2.9 GMV
    "monthly_kpis": gmv.monthly_kpis,
    "gmv_bridge": gmv.gmv_bridge,
    "growth_accounting": gmv.growth_accounting,
    "category_mix": gmv.category_mix,
    "margin_by_tenure": gmv.margin_by_tenure,
    "customer_rfm": rfm.customer_rfm_public,
    "rfm_summary": rfm.rfm_summary,
    "rfm_bad_first": rfm.rfm_bad_first,
    # 2.10 marketplace, experience
    "store_month_ops": marketplace.store_month_ops,
    "store_pre_post": marketplace.store_pre_post,
    "demand_heatmap": marketplace.demand_heatmap,
    "repeat_vs_on_time": marketplace.repeat_vs_on_time,
    "heart_monthly": experience.heart_monthly,
    "reorder_by_rating": experience.reorder_by_rating,
    "rating_by_experience": experience.rating_by_experience,
    # 2.11 health
    "customer_health": health.customer_health,
    "health_tier_summary": health.health_tier_summary,
    "health_by_zone": health.health_by_zone,
    "product_health": health.product_health,
    "product_tier_mix": health.product_tier_mix,
    "product_review_list": health.product_review_list,
    # 2.12 BI feeds
    **feeds.FEEDS,
    "feed_order_month": lambda star: with_counts(feeds.feed_order_month(star)),
    # 2.13 measure layer (page datasets are measure_query calls)
    **measures.PAGE_QUERIES,
    # 2.14 report metrics
    "bad_first_share": report.bad_first_share,
    "same_day_share_of_buyers": report.same_day_share_of_buyers,
    "ops_pooled_stressed_vs_other": report.ops_pooled_stressed_vs_other,
    "zone_unhealthy_share": report.zone_unhealthy_share,
    "discount_led_share": report.discount_led_share,
    "blended_retention": report.blended_retention,
    "search_share": report.search_share,
    "top_segments_share": report.top_segments_share,
    "reorder_low_rating": report.reorder_low_rating,
    "avg_contribution_per_order": report.avg_contribution_per_order,
    "high_margin_attach": report.high_margin_attach,
    "bad_first_opportunity": report.bad_first_opportunity,
}
