"""Measure layer: named aggregates over the BI feeds, sliceable.

``measure_query(star, measures, by, filters)`` groups each requested measure's
fact by the ``by`` attributes and returns one row per slice.  Every measure is
recomputed from its fact's grain for each slice (distinct counts and cohort
sizes are not additive), and measures from different facts are combined with
a union + group-by on the slice keys instead of joins.

Ratios follow DIVIDE semantics (NULL on a zero denominator) and are rounded
like the reports: percentages to 1 decimal, money per unit to 0, orders per
active to 2, minutes to 1, ratings to 2.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import pct, round_ratio
from ..plans.base import customer_first, dim_date, session_funnel
from ..sources.star import Star
from .feed_store import Feeds, persisted_feeds, with_history
from .feeds import (cohort_grid, fact_orders_by_month, feed_dim_store, feed_funnel_monthly, feed_marketing,
                    funnel_monthly)
from .health import customer_health
from .order_parts import GID, ORDER_PARTS, gid, grouped, merged, partial, sums_of_feed
from .retention import retention_triangle
from .rfm import customer_rfm

# attributes of a day from dim_date, joined on the date key of each fact; the first three are those of its month too
_OF_MONTH = {"year", "month_name", "year_month"}
CALENDAR = _OF_MONTH | {"day_of_week", "day_name", "is_weekend", "week_start"}
# slicer attributes each fact can be grouped or filtered by
FACT_ATTRS = {
    "orders": {"month", "order_date", "store_id", "zone_name", "city", "capacity_profile", "status",
               "acquisition_channel", "platform", "cohort_month", "rfm_segment", "customer_health_tier"} | CALENDAR,
    "customers": {"month", "acquisition_channel", "platform", "cohort_month", "rfm_segment",
                  "customer_health_tier", "zone_name", "home_store_id"} | CALENDAR,
    "funnel": {"month", "platform", "acquisition_channel"} | CALENDAR,
    "marketing": {"month", "acquisition_channel"} | _OF_MONTH,
    "cohort": {"cohort_month", "month_offset"},
}
# those that the written feeds keep
FEED_ATTRS = FACT_ATTRS | {
    "orders": {"month", "store_id", "zone_name", "city", "capacity_profile", "acquisition_channel", "platform"} | _OF_MONTH,
    "funnel": {"month", "platform", "acquisition_channel"} | _OF_MONTH,
}
_CUSTOMER_ATTRS = {"acquisition_channel", "platform", "cohort_month", "rfm_segment", "customer_health_tier"}
_STORE_ATTRS = {"zone_name", "city", "capacity_profile"}


def _s(c: str) -> Column:
    return F.col(c)


@dataclass(frozen=True)
class Measure:
    fact: str
    parts: tuple            # ((alias, aggregate Column factory), ...)
    final: object           # callable(prefix) -> Column over the part aliases
    needs_month: bool = False


def _om(parts, final, needs_month=False) -> Measure:
    return Measure("orders", tuple((p, ORDER_PARTS[p]) for p in parts), final, needs_month)


def _sum(col):
    return lambda: F.sum(col)


MEASURES: dict[str, Measure] = {
    # core
    "delivered_orders": _om(["_do"], lambda x: _s(x + "_do")),
    "gmv": _om(["_gmv"], lambda x: _s(x + "_gmv")),
    "net_revenue": _om(["_net"], lambda x: _s(x + "_net")),
    "discounts": _om(["_disc"], lambda x: _s(x + "_disc")),
    "discount_rate_pct": _om(["_disc", "_gmv"], lambda x: pct(x + "_disc", x + "_gmv")),
    "aov": _om(["_gmv", "_do"], lambda x: round_ratio(x + "_gmv", x + "_do", 0)),
    "active_customers": _om(["_act"], lambda x: _s(x + "_act")),
    "orders_per_active": _om(["_do", "_act"], lambda x: round_ratio(x + "_do", x + "_act", 2)),
    "contribution": _om(["_contrib"], lambda x: _s(x + "_contrib")),
    "contribution_per_order": _om(["_contrib", "_do"], lambda x: round_ratio(x + "_contrib", x + "_do", 0)),
    "item_margin_pct": _om(["_margin", "_gmv"], lambda x: pct(x + "_margin", x + "_gmv")),
    # growth (previous calendar month of the same slice)
    "gmv_pm": _om(["_gmv"], lambda x: _s(x + "_gmv_pm"), True),
    "gmv_mom_pct": _om(["_gmv"], lambda x: pct(_s(x + "_gmv") - _s(x + "_gmv_pm"), x + "_gmv_pm"), True),
    "active_customers_pm": _om(["_act"], lambda x: _s(x + "_act_pm"), True),
    "new_customers": Measure("customers", (("_new", lambda: F.count(F.lit(1))),), lambda x: _s(x + "_new")),
    # operations / experience
    "on_time_pct": _om(["_ontime", "_do"], lambda x: pct(x + "_ontime", x + "_do")),
    "perfect_order_pct": _om(["_perfect", "_do"], lambda x: pct(x + "_perfect", x + "_do")),
    "late_5plus_pct": _om(["_late", "_do"], lambda x: pct(x + "_late", x + "_do")),
    "avg_delivery_min": _om(["_dmin", "_dminn"], lambda x: round_ratio(x + "_dmin", x + "_dminn", 1)),
    "cancellation_pct": _om(["_canc", "_all"], lambda x: pct(x + "_canc", x + "_all")),
    "avg_rating": _om(["_rsum", "_rn"], lambda x: round_ratio(x + "_rsum", x + "_rn", 2)),
    "items_missing_pct": _om(["_miss", "_do"], lambda x: pct(x + "_miss", x + "_do")),
    # funnel
    "searches": Measure("funnel", (("_sea", _sum("searched")),), lambda x: _s(x + "_sea")),
    "product_views": Measure("funnel", (("_pv", _sum("reached_product_view")),), lambda x: _s(x + "_pv")),
    "carts": Measure("funnel", (("_cart", _sum("reached_cart")),), lambda x: _s(x + "_cart")),
    "checkouts": Measure("funnel", (("_co", _sum("reached_checkout")),), lambda x: _s(x + "_co")),
    "sessions": Measure("funnel", (("_ses", _sum("sessions")),), lambda x: _s(x + "_ses")),
    "converted_sessions": Measure("funnel", (("_conv", _sum("converted")),), lambda x: _s(x + "_conv")),
    "session_conversion_pct": Measure("funnel", (("_conv", _sum("converted")), ("_ses", _sum("sessions"))),
                                      lambda x: pct(x + "_conv", x + "_ses")),
    "cart_reach_pct": Measure("funnel", (("_cart", _sum("reached_cart")), ("_ses", _sum("sessions"))),
                              lambda x: pct(x + "_cart", x + "_ses")),
    "cart_to_checkout_pct": Measure("funnel", (("_co", _sum("reached_checkout")), ("_cart", _sum("reached_cart"))),
                                    lambda x: pct(x + "_co", x + "_cart")),
    # acquisition
    "marketing_spend": Measure("marketing", (("_sp", _sum("spend_inr")),), lambda x: _s(x + "_sp")),
    "signups": Measure("marketing", (("_su", _sum("signups")),), lambda x: _s(x + "_su")),
    "activated_signups": Measure("marketing", (("_as", _sum("activated_7d")),), lambda x: _s(x + "_as")),
    "cac": Measure("marketing", (("_sp", _sum("spend_inr")), ("_su", _sum("signups"))),
                   lambda x: round_ratio(x + "_sp", x + "_su", 0)),
    "cac_per_activated": Measure("marketing", (("_sp", _sum("spend_inr")), ("_as", _sum("activated_7d"))),
                                 lambda x: round_ratio(x + "_sp", x + "_as", 0)),
    "activation_pct": Measure("marketing", (("_as", _sum("activated_7d")), ("_su", _sum("signups"))),
                              lambda x: pct(x + "_as", x + "_su")),
    # retention (cohort size is per cohort: summed over distinct cohorts of a slice)
    "cohort_size": Measure("cohort", (("_size", None),), lambda x: _s(x + "_size")),
    "cohort_actives": Measure("cohort", (("_actv", None),), lambda x: _s(x + "_actv")),
    "retention_pct": Measure("cohort", (("_actv", None), ("_size", None)), lambda x: pct(x + "_actv", x + "_size")),
}


def _customer_dims(star: Star, attrs: set[str]) -> DataFrame:
    """customer_id plus only the requested attributes (RFM / health are built
    only when asked for: their NTILE scoring is not free)."""
    cf = customer_first(star)
    base_cols = sorted(attrs & {"acquisition_channel", "platform", "cohort_month", "home_store_id", "signup_date"})
    out = cf.select("customer_id", *base_cols)
    if "rfm_segment" in attrs:
        out = out.join(customer_rfm(star).select("customer_id", "rfm_segment"), "customer_id", "left")
    if "customer_health_tier" in attrs:
        out = out.join(customer_health(star).select("customer_id", F.col("health_tier").alias("customer_health_tier")),
                       "customer_id", "left")
    return out


def _with_calendar(days: DataFrame, fact: DataFrame, day: str, need: set[str], month: str | None = None) -> DataFrame:
    """``fact`` with the calendar attributes of its date ``day``.

    The calendar is broadcast (a row a day).  Where the fact also has its ``month``, the join names it too, so a filter
    on a calendar attribute prunes the fact's month partitions while the query runs.
    """
    attrs = sorted(need & CALENDAR)
    if not attrs:
        return fact
    calendar = days.select(F.col("date_key").alias("_day"), F.col("month_start").alias("_month"), *attrs)
    same = F.col(day) == F.col("_day")
    if month:
        same = same & (F.col(month) == F.col("_month"))
    return fact.join(F.broadcast(calendar), same).drop("_day", "_month")


def _with_stores(stores: DataFrame, fact: DataFrame, key: str, need: set[str]) -> DataFrame:
    if not need & _STORE_ATTRS:
        return fact
    stores = stores.select(F.col("store_id").alias(key), *sorted(need & _STORE_ATTRS))
    return fact.join(F.broadcast(stores), key, "left")  # one row per store: bounded


def _orders_fact(star: Star, need: set[str], parts) -> DataFrame:
    margin = bool({"_contrib", "_margin"} & set(parts))  # else the order lines stay unread
    f = fact_orders_by_month(star, margin)  # month = storage partition column when present: month filters prune
    f = _with_stores(feed_dim_store(star), f, "store_id", need)
    return _with_calendar(dim_date(star), f, "order_date", need, "month")


def _orders_by_customer_slice(star: Star, parts: list[str], by: list[str], filters: dict, levels) -> DataFrame:
    """Order parts summed per (customer, order-side slice keys), then joined to
    the customer attributes: the join sees one row per customer and slice, not
    one per order, so a customer with a huge share of orders is not a hot key.
    Grouping sets expand these rows, and count a customer once in each."""
    need = set(by) | set(filters)
    cust = need & _CUSTOMER_ATTRS
    order_keys = sorted(need - cust)
    f = _apply_filters(_orders_fact(star, need - cust, parts),
                       {k: v for k, v in filters.items() if k not in cust})
    per = f.groupBy("customer_id", *order_keys).agg(*[partial(a).alias(a) for a in parts])
    if cust:
        per = per.join(_customer_dims(star, cust), "customer_id", "left")
        per = _apply_filters(per, {k: v for k, v in filters.items() if k in cust})
    if levels:
        once = [F.max(a).alias(a) if a == "_act" else merged(a).alias(a) for a in parts]
        per = grouped(per, by, levels, "customer_id").agg(*once, *gid(by, levels))
    return per.groupBy(*by, *GID[:bool(levels)]).agg(*[merged(a).alias("m_" + a) for a in parts])


def _customers_fact(src: Star | Feeds, need: set[str]) -> DataFrame:
    if isinstance(src, Feeds):
        f = src.frame("feed_dim_customer")
    else:
        attrs = (need - {"month", "zone_name"} - CALENDAR) | {"signup_date"} | (
            {"home_store_id"} if "zone_name" in need else set())
        f = _customer_dims(src, attrs)
    f = f.withColumn("month", F.trunc("signup_date", "month"))
    if need & _STORE_ATTRS:
        stores = src.frame("feed_dim_store") if isinstance(src, Feeds) else feed_dim_store(src)
        f = _with_stores(stores, f, "home_store_id", need)
    return _with_calendar(_days(src), f, "signup_date", need) if need & CALENDAR else f


def _days(src: Star | Feeds) -> DataFrame:
    return src.frame("feed_dim_date") if isinstance(src, Feeds) else dim_date(src)


def _funnel_fact(src: Star | Feeds, need: set[str]) -> DataFrame:
    if not isinstance(src, Feeds) and need & (CALENDAR - _OF_MONTH):  # by day: the monthly feed is too coarse
        sessions = session_funnel(src).withColumn("session_date", F.col("session_start").cast("date"))
        f = funnel_monthly(sessions, src.customer, ("session_month", "session_date"))
        return _with_calendar(_days(src), f.withColumnRenamed("session_month", "month"), "session_date", need, "month")
    f = src.frame("feed_funnel_monthly") if isinstance(src, Feeds) else feed_funnel_monthly(src)
    return _by_month(src, f.withColumnRenamed("session_month", "month"), need)


def _by_month(src: Star | Feeds, fact: DataFrame, need: set[str]) -> DataFrame:
    """A fact by month, whose date key is the first day of the month."""
    return _with_calendar(_days(src), fact, "month", need) if need & CALENDAR else fact


def _fact(src: Star | Feeds, fact: str, need: set[str], parts) -> DataFrame:
    if fact == "orders" and isinstance(src, Feeds):
        f = src.frame("feed_order_month")
        if need & _STORE_ATTRS:
            f = _with_stores(src.frame("feed_dim_store"), f, "store_id", need)
        return _by_month(src, f, need)
    if fact == "orders":
        return _orders_fact(src, need, parts)
    if fact == "customers":
        return _customers_fact(src, need)
    if fact == "funnel":
        return _funnel_fact(src, need)
    if fact == "marketing":
        f = src.frame("feed_marketing") if isinstance(src, Feeds) else feed_marketing(src)
        return _by_month(src, f.withColumnRenamed("month_start", "month")
                         .withColumnRenamed("channel", "acquisition_channel"), need)
    return src.cohorts() if isinstance(src, Feeds) else cohort_grid(src)


def _apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    for col, cond in filters.items():
        if isinstance(cond, tuple):
            lo, hi = cond
            df = df.filter(F.col(col).between(F.lit(lo), F.lit(hi)))
        elif isinstance(cond, (list, set, frozenset)):
            df = df.filter(F.col(col).isin(list(cond)))
        else:
            df = df.filter(F.col(col) == F.lit(cond))
    return df


def _grouped(src: Star | Feeds, fact: str, parts: dict, by: list[str], filters: dict, levels=None) -> DataFrame:
    """The parts (as ``m_`` + alias) per slice; with ``levels`` per slice of every grouping set, named by ``gid``."""
    need = set(by) | set(filters)
    # orders sliced by a customer attribute are pre-aggregated per customer, not joined row by row
    if fact == "orders" and not isinstance(src, Feeds) and (levels or need & _CUSTOMER_ATTRS):
        return _orders_by_customer_slice(src, list(parts), by, filters, levels)
    f = _apply_filters(_fact(src, fact, need, parts), filters)
    if fact == "orders" and isinstance(src, Feeds):
        return sums_of_feed(f, list(parts), by, levels)
    if fact == "cohort":  # the size of a cohort counts once, whatever offsets a slice unites
        per = grouped(f.withColumn("_cohort", F.col("cohort_month")), by, levels, "_cohort").agg(
            F.max("cohort_size").alias("_sz"), F.sum("active_customers").alias("_ac"), *gid(by, levels))
        return per.groupBy(*by, *GID[:bool(levels)]).agg(F.sum("_sz").alias("m__size"), F.sum("_ac").alias("m__actv"))
    return grouped(f, by, levels).agg(*[fn().alias("m_" + a) for a, fn in parts.items()], *gid(by, levels))


def _month_before(day: _dt.date) -> _dt.date:
    return (day.replace(day=1) - _dt.timedelta(days=1)).replace(day=1)


def _each(cond, change):
    """``cond`` with ``change`` applied to every day it names."""
    if isinstance(cond, tuple):
        return tuple(change(c) for c in cond)
    if isinstance(cond, (list, set, frozenset)):
        return sorted({change(c) for c in cond})
    return change(cond)


def _with_previous(src: Star | Feeds, fact: str, g: DataFrame, parts: dict, by: list[str], filters: dict) -> DataFrame:
    """``g`` with each part of the previous month as ``..._pm``.

    By month: each slice's own previous month, read from outside the month filter where it lies there.  Without month
    in ``by``: the month before the first one that the filter admits (NULL without a filter that names months).  The
    previous month is a whole one: filters on days and calendar attributes do not hold for it, but a filter on days
    tells the months as one on months does.
    """
    if set(by) & ({"order_date"} | CALENDAR):
        raise ValueError("measures of the previous month cannot be split by days or calendar attributes")
    pm = [F.col("m_" + a).alias("m_" + a + "_pm") for a in parts]
    rest = {k: v for k, v in filters.items() if k not in {"month", "order_date"} | CALENDAR}
    months = filters.get("month", _each(filters["order_date"], lambda d: d.replace(day=1)) if "order_date" in filters
                         else None)
    if "month" in by:
        earlier = rest | ({} if months is None else {"month": _each(months, _month_before)})
        prev = _grouped(src, fact, parts, by, earlier).select(
            *[(F.add_months("month", 1) if c == "month" else F.col(c)).alias("p_" + c) for c in by], *pm)
    elif months is not None:
        first = months if isinstance(months, _dt.date) else min(months)
        prev = _grouped(src, fact, parts, by, rest | {"month": _month_before(first)}).select(
            *[F.col(c).alias("p_" + c) for c in by], *pm)
    else:
        return g.select("*", *[F.lit(None).cast(g.schema["m_" + a].dataType).alias("m_" + a + "_pm") for a in parts])
    if not by:  # one row each
        both = g.unionByName(prev, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("p_" + c)) for c in by])
    return g.join(prev, same, "left").drop(*["p_" + c for c in by])


def _fact_result(src: Star | Feeds, fact: str, names: list[str], by: list[str], filters: dict, levels) -> DataFrame:
    bad = (set(by) | set(filters)) - (FEED_ATTRS if isinstance(src, Feeds) else FACT_ATTRS)[fact]
    if bad:
        raise ValueError(f"measures {names} ({fact}) cannot be sliced by {sorted(bad)}")
    parts = {alias: fn for n in names for alias, fn in MEASURES[n].parts}
    g = _grouped(src, fact, parts, by, filters, levels)
    if any(MEASURES[n].needs_month for n in names):
        if levels:
            raise ValueError("measures of the previous month have no totals")
        g = _with_previous(src, fact, g, parts, by, filters)
    return g.select(*by, *GID[:bool(levels)], *[MEASURES[n].final("m_").alias(n) for n in names])


def measure_query(src: Star | Feeds, measures: list[str], by: list[str] | None = None,
                  filters: dict | None = None, totals: bool | list[tuple[str, ...]] = False) -> DataFrame:
    """One row a slice; from the star's facts, or from the written feeds alone.

    ``totals`` adds the rows, columns and grand totals of a matrix (all subsets of ``by``, or the listed ones), every
    measure computed anew for each: NULL in a totalled column, and 1 in its ``<column>_total``.  A total of a fact
    without rows is NULL.
    """
    by, filters = list(by or []), dict(filters or {})
    unknown = [m for m in measures if m not in MEASURES]
    if unknown:
        raise KeyError(f"unknown measures {unknown}")
    levels = [c for n in range(len(by), -1, -1) for c in combinations(by, n)] if totals is True else totals or None
    facts: dict[str, list[str]] = {}
    for m in measures:
        facts.setdefault(MEASURES[m].fact, []).append(m)
    results = [_fact_result(src, fact, names, by, filters, levels) for fact, names in facts.items()]
    keys = by + GID[:bool(levels)]
    united = results[0]
    if len(results) > 1:
        united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
        united = united.groupBy(*keys).agg(*[F.max(m).alias(m) for m in measures])
    flags = [F.getbit("gid", F.lit(k)).cast("int").alias(f"{c}_total") for k, c in enumerate(by)] if levels else []
    return united.select(*by, *flags, *measures)


# ---- page datasets (registered queries) ------------------------------------
_CORE = ["delivered_orders", "gmv", "net_revenue", "discounts", "discount_rate_pct", "aov", "active_customers",
         "orders_per_active", "contribution", "contribution_per_order", "item_margin_pct"]
_OPS = ["on_time_pct", "perfect_order_pct", "late_5plus_pct", "avg_delivery_min", "cancellation_pct", "avg_rating"]
_FUNNEL = ["sessions", "converted_sessions", "session_conversion_pct", "cart_reach_pct", "cart_to_checkout_pct"]
_ACQ = ["marketing_spend", "signups", "activated_signups", "cac", "cac_per_activated", "activation_pct"]
_RET = ["cohort_size", "cohort_actives", "retention_pct"]


def measure_totals(star: Star) -> DataFrame:
    return measure_query(star, _CORE + ["new_customers"] + _OPS + _FUNNEL + _ACQ + _RET)


def measures_by_month(star: Star) -> DataFrame:
    return measure_query(star, ["gmv", "active_customers", "delivered_orders", "aov", "perfect_order_pct",
                                "gmv_pm", "gmv_mom_pct", "active_customers_pm", "new_customers"], by=["month"])


def measures_by_month_zone(star: Star) -> DataFrame:
    return measure_query(star, ["gmv", "on_time_pct", "avg_delivery_min", "avg_rating", "cancellation_pct"],
                         by=["month", "zone_name"])


def funnel_by_month_platform(star: Star) -> DataFrame:
    return measure_query(star, _FUNNEL, by=["month", "platform"])


def acquisition_by_channel(star: Star) -> DataFrame:
    return measure_query(star, _ACQ, by=["acquisition_channel"])


def retention_matrix(star: Star) -> DataFrame:
    return measure_query(star, _RET, by=["cohort_month", "month_offset"])


def net_revenue_by_segment(star: Star) -> DataFrame:
    return measure_query(star, ["net_revenue", "delivered_orders", "active_customers"], by=["rfm_segment"])


def channel_economics_stress_period(star: Star) -> DataFrame:
    """Core economics by channel, filtered to months from the stress start on."""
    p = star.params
    return measure_query(star, ["gmv", "contribution_per_order", "item_margin_pct", "signups", "cac"],
                         by=["acquisition_channel"], filters={"month": (p.stress_start, p.as_of)})


def acquisition_by_month_channel(star: Star) -> DataFrame:
    return measure_query(star, ["signups", "activated_signups", "marketing_spend", "cac"],
                         by=["month", "acquisition_channel"])


def retention_curve(star: Star) -> DataFrame:
    """Retention by months since signup, pooled over the cohorts present at each offset."""
    return measure_query(star, _RET, by=["month_offset"])


def health_tiers_by_zone(star: Star) -> DataFrame:
    return measure_query(star, ["new_customers"], by=["zone_name", "customer_health_tier"])


def zone_ops_since_stress(star: Star) -> DataFrame:
    p = star.params
    return measure_query(star, ["on_time_pct", "late_5plus_pct", "cancellation_pct", "avg_rating"],
                         by=["zone_name"], filters={"month": (p.stress_start, p.as_of)})


def items_missing_by_zone_since_stress(star: Star) -> DataFrame:
    p = star.params
    return measure_query(star, ["delivered_orders", "items_missing_pct"], by=["zone_name"],
                         filters={"month": (p.stress_start, p.as_of)})


def funnel_stages_by_platform(star: Star) -> DataFrame:
    return measure_query(star, ["sessions", "searches", "product_views", "carts", "checkouts", "converted_sessions"],
                         by=["platform", "acquisition_channel"])


def kpis_by_month_since_stress(star: Star) -> DataFrame:
    """A month slicer: the first month shown still has its previous month."""
    p = star.params
    return measure_query(star, ["gmv", "gmv_pm", "gmv_mom_pct", "active_customers", "active_customers_pm"],
                         by=["month"], filters={"month": (p.stress_start, p.as_of)})


def kpi_card_stress_month(star: Star) -> DataFrame:
    """KPI cards under a single-month slicer."""
    return measure_query(star, ["gmv", "gmv_pm", "gmv_mom_pct"], filters={"month": star.params.stress_start})


def orders_by_weekday(star: Star) -> DataFrame:
    """Three facts by the weekday of their own date: order, signup and session start."""
    return measure_query(star, ["delivered_orders", "gmv", "active_customers", "on_time_pct", "new_customers",
                                "sessions", "session_conversion_pct"], by=["day_of_week", "day_name"])


def weekend_by_zone_since_stress(star: Star) -> DataFrame:
    p = star.params
    return measure_query(star, ["delivered_orders", "active_customers", "aov", "late_5plus_pct"],
                         by=["zone_name", "is_weekend"], filters={"month": (p.stress_start, p.as_of)})


def weekly_kpis_of_stress_year(star: Star) -> DataFrame:
    """A year slicer on the calendar: the months of other years are pruned while the query runs."""
    return measure_query(star, ["gmv", "delivered_orders", "active_customers", "orders_per_active", "sessions"],
                         by=["week_start"], filters={"year": star.params.stress_start.year})


def kpi_card_stress_days(star: Star) -> DataFrame:
    """KPI cards under a slicer of days: the previous month is the whole month before the first day."""
    first = star.params.stress_start
    return measure_query(star, ["gmv", "gmv_pm", "active_customers_pm"],
                         filters={"order_date": (first, first + _dt.timedelta(days=13))})


def zone_month_matrix(star: Star) -> DataFrame:
    """Zone x month with row, column and grand totals."""
    return measure_query(star, ["on_time_pct", "avg_rating", "active_customers", "orders_per_active", "gmv"],
                         by=["zone_name", "month"], totals=True)


def retention_matrix_totals(star: Star) -> DataFrame:
    """Cohort x offset with the totals of cohorts, of offsets and of all."""
    return measure_query(star, _RET, by=["cohort_month", "month_offset"], totals=True)


def channel_month_totals(star: Star) -> DataFrame:
    """Measures of three facts by channel and month, with totals."""
    return measure_query(star, ["active_customers", "aov", "contribution_per_order", "new_customers", "cac"],
                         by=["acquisition_channel", "month"], totals=True)


_FEED_KPIS = ["active_customers", "orders_per_active", "gmv", "contribution_per_order", "item_margin_pct", "on_time_pct"]


def feed_kpis_by_month(star: Star) -> DataFrame:
    """From the written order feed alone: distinct customers of a month are the united bitmaps of its rows."""
    return measure_query(persisted_feeds(star, "feed_order_month"), _FEED_KPIS + ["active_customers_pm", "gmv_mom_pct"],
                         by=["month"])


def feed_kpis_by_zone_channel(star: Star) -> DataFrame:
    p = star.params
    return measure_query(persisted_feeds(star, "feed_order_month", "feed_dim_store"), _FEED_KPIS,
                         by=["zone_name", "acquisition_channel"], filters={"month": (p.stress_start, p.as_of)}, totals=True)


def feed_measure_totals(star: Star) -> DataFrame:
    """``measure_totals`` from the written feeds: no fact of the star is read."""
    feeds = persisted_feeds(star, "feed_order_month", "feed_dim_customer", "feed_funnel_monthly", "feed_marketing",
                            "feed_cohort_retention")
    return measure_query(feeds, _CORE + ["new_customers"] + _OPS + _FUNNEL + _ACQ + _RET)


def history_retention_triangle(star: Star) -> DataFrame:
    """``retention_triangle`` from the kept bit sets of customers: no order is read."""
    return retention_triangle(with_history(star, persisted_feeds(star, "feed_customer_months")))


def history_retention_curve(star: Star) -> DataFrame:
    return retention_curve(with_history(star, persisted_feeds(star, "feed_customer_months")))


PAGE_QUERIES = {
    "history_retention_triangle": history_retention_triangle,
    "history_retention_curve": history_retention_curve,
    "orders_by_weekday": orders_by_weekday,
    "weekend_by_zone_since_stress": weekend_by_zone_since_stress,
    "weekly_kpis_of_stress_year": weekly_kpis_of_stress_year,
    "kpi_card_stress_days": kpi_card_stress_days,
    "zone_month_matrix": zone_month_matrix,
    "retention_matrix_totals": retention_matrix_totals,
    "channel_month_totals": channel_month_totals,
    "feed_kpis_by_month": feed_kpis_by_month,
    "feed_kpis_by_zone_channel": feed_kpis_by_zone_channel,
    "feed_measure_totals": feed_measure_totals,
    "items_missing_by_zone_since_stress": items_missing_by_zone_since_stress,
    "funnel_stages_by_platform": funnel_stages_by_platform,
    "kpis_by_month_since_stress": kpis_by_month_since_stress,
    "kpi_card_stress_month": kpi_card_stress_month,
    "measure_totals": measure_totals,
    "measures_by_month": measures_by_month,
    "measures_by_month_zone": measures_by_month_zone,
    "funnel_by_month_platform": funnel_by_month_platform,
    "acquisition_by_channel": acquisition_by_channel,
    "retention_matrix": retention_matrix,
    "net_revenue_by_segment": net_revenue_by_segment,
    "channel_economics_stress_period": channel_economics_stress_period,
    "acquisition_by_month_channel": acquisition_by_month_channel,
    "retention_curve": retention_curve,
    "health_tiers_by_zone": health_tiers_by_zone,
    "zone_ops_since_stress": zone_ops_since_stress,
}
