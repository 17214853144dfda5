"""Adapter: the driver's TPC-H style tables -> the commerce star schema.

Deterministic integer rules (FIXTURES.md section 3), so this Spark version and
the DuckDB version in ``oracle/`` agree bit for bit.  Everything is a lazy
DataFrame; Catalyst prunes whatever a query does not read.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURES, Params
from ..functions.dates import epoch_second, from_epoch_second, month_start, ts_lit
from ..functions.ratios import idiv
from ..plans.sessionize import sessionize
from ..plans.skew import join_per_key, pieces
from .star import Star

# Fixed values of the fixture rules (FIXTURES.md section 3).
LAUNCH_DATE = _dt.date(1994, 1, 1)
PEAK_HOURS = [8, 9, 10, 18, 19, 20, 21]
ADAPTER_STRESSED_STORES = [4, 6]
ADAPTER_STRESS_START = _dt.date(2000, 1, 1)
PAYMENT_METHODS = ["upi", "card", "cod", "wallet"]
NO_ORDER_SIGNUP_BASE = _dt.date(1995, 1, 1)
SEGMENT_CHANNEL = {
    "AUTOMOBILE": "paid_search",
    "BUILDING": "organic",
    "FURNITURE": "paid_social",
    "HOUSEHOLD": "referral",
    "MACHINERY": "influencer",
}
CHANNEL_COST_PER_SIGNUP = {
    "organic": 0,
    "referral": 120,
    "paid_social": 300,
    "paid_search": 270,
    "influencer": 380,
}
EVENT_NAMES = {
    "view": "product_view",
    "click": "add_to_cart",
    "signup": "checkout_start",
    "purchase": "payment_success",
    "error": "search",
}
EVENT_SHIFT_DAYS = 8219
PRIVATE_LABEL_BRAND = "Brand#1"

#: Lines and events in one piece of their shuffles, on average: some 200 MB of a task's memory.
LINES_A_PIECE, EVENTS_A_PIECE = 200_000, 50_000


def _map(col, mapping: dict) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, v) if expr is None else expr.when(col == k, v))
    return expr


def _cents(x) -> F.Column:
    return F.round(F.col(x) * 100).cast("long")


def tpch_star(spark: SparkSession, sf_dir: str, params: Params = FIXTURES) -> Star:
    rd = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")

    # dim_store: nations are stores, regions their cities (25 / 5 rows by spec).
    nation, region = rd("nation"), rd("region")
    store = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
             .select(F.col("n_nationkey").cast("long").alias("store_id"),
                     F.concat(F.lit("ST-"), F.col("n_nationkey").cast("string")).alias("store_code"),
                     F.col("n_name").alias("zone_name"),
                     F.col("r_name").alias("city"),
                     F.lit(LAUNCH_DATE).alias("launch_date"),
                     (F.lit(10) + F.col("n_nationkey") % 5).cast("long").alias("base_promise_min")))

    # dim_product
    cents = _cents("p_retailprice")
    product = rd("part").select(
        F.col("p_partkey").cast("long").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        idiv(cents + 50, F.lit(100)).alias("unit_price"),
        idiv(cents * (F.lit(60) + F.col("p_size") % 30), F.lit(10000)).alias("unit_cost"),
        F.when(F.col("p_brand") == PRIVATE_LABEL_BRAND, 1).otherwise(0).alias("is_private_label"))

    # fact_order_items: the (order, part) grouping repairs duplicate keys.
    lines = rd("lineitem").select(
        F.col("l_orderkey").cast("long").alias("order_id"),
        F.col("l_partkey").cast("long").alias("product_id"),
        F.col("l_quantity").cast("long").alias("qty"),
        idiv(_cents("l_extendedprice") + 50, F.lit(100)).alias("amt"),
        idiv(_cents("l_extendedprice") * _cents("l_discount") + 5000, F.lit(10000)).alias("disc"))
    # One hash shuffle by order id serves the (order, part) grouping, the order
    # totals and the join with orders (an order has a handful of lines: no hot key).
    line_pieces = pieces(rd("lineitem"), LINES_A_PIECE)
    lines = lines.repartition(line_pieces, "order_id")
    groups = (lines.groupBy("order_id", "product_id")
              .agg(F.sum("qty").alias("quantity"), F.sum("amt").alias("line_amount"),
                   F.sum("disc").alias("disc_amount")))
    items = groups.select("order_id", "product_id", "quantity",
                          idiv(F.col("line_amount"), F.col("quantity")).alias("unit_price"),
                          "line_amount")
    totals = (groups.groupBy("order_id")
              .agg(F.sum("line_amount").alias("lines_total"), F.sum("disc_amount").alias("disc_total")))

    # fact_orders
    o = rd("orders").select(
        F.col("o_orderkey").cast("long").alias("order_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        "o_orderstatus", "o_orderpriority",
        F.timestamp_add("SECOND", (F.col("o_orderkey") * 7919) % 86400,
                        F.col("o_orderdate").cast("timestamp_ntz")).alias("order_ts"))
    cust_raw = rd("customer").select(F.col("c_custkey").cast("long").alias("customer_id"),
                                     F.col("c_nationkey").cast("long").alias("nationkey"),
                                     "c_mktsegment")
    k = F.col("order_id")
    cancelled = (((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"))
                 | (F.col("customer_id") % 20 == 19))
    store_id = F.when(k % 25 == 0, (F.col("nationkey") + 1) % 25).otherwise(F.col("nationkey"))
    promised = (F.lit(10) + F.col("store_id") % 5
                + F.when(F.hour("order_ts").isin(PEAK_HOURS), 2).otherwise(0))
    stress = F.when(F.col("store_id").isin(ADAPTER_STRESSED_STORES)
                    & (F.col("order_ts") >= ts_lit(ADAPTER_STRESS_START)), 6).otherwise(0)
    actual = F.when(F.col("status") == "cancelled", F.lit(None).cast("long")).otherwise(
        F.col("promised_min") + (k * 31) % 17 - 10 + stress)
    missing = F.when((F.col("status") == "delivered") & ((k * 13) % 29 == 0), 1).otherwise(0)
    item_total = F.coalesce(F.col("lines_total"), F.lit(0).cast("long"))
    discount = F.when(F.col("o_orderpriority") == "1-URGENT",
                      F.coalesce(F.col("disc_total"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    act, prom = F.col("actual_delivery_min"), F.col("promised_min")
    rating = F.when((F.col("status") == "cancelled") | (k % 2 == 0), F.lit(None).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"),
                   (F.lit(5) - F.when(act > prom, 1).otherwise(0)
                    - 2 * F.when(act > prom + 5, 1).otherwise(0)
                    - F.col("items_missing")
                    - F.when(k % 7 == 0, 1).otherwise(0)).cast("long")))
    pay = F.element_at(F.array(*[F.lit(p) for p in PAYMENT_METHODS]), (k % 4 + 1).cast("int"))
    # a customer may own a large share of orders: hot customers meet their nation by broadcast
    orders = (join_per_key(o, cust_raw.select("customer_id", "nationkey"), "customer_id",
                           params.hot_key_rows, "left")
              .join(totals, "order_id", "left")
              .withColumn("store_id", store_id.cast("long"))
              .withColumn("status", F.when(cancelled, "cancelled").otherwise("delivered"))
              .withColumn("promised_min", promised.cast("long"))
              .withColumn("actual_delivery_min", actual.cast("long"))
              .withColumn("items_missing", missing.cast("int"))
              .withColumn("item_total", item_total)
              .withColumn("discount_amount", discount)
              .withColumn("delivery_fee", F.when(F.col("item_total") < 100000, 25).otherwise(0).cast("long"))
              .withColumn("handling_fee", F.lit(4).cast("long"))
              .withColumn("net_amount", F.col("item_total") - F.col("discount_amount")
                          + F.col("delivery_fee") + F.col("handling_fee"))
              .withColumn("payment_method", pay)
              .withColumn("rating", rating)
              .select("order_id", "customer_id", "store_id", "order_ts", "status", "promised_min",
                      "actual_delivery_min", "item_total", "discount_amount", "delivery_fee",
                      "handling_fee", "net_amount", "payment_method", "rating", "items_missing"))

    # dim_customer: signup shortly before the first order of any status.
    first_ts = o.groupBy("customer_id").agg(F.min("order_ts").alias("first_any_ts"))
    ck = F.col("customer_id")
    back = ((ck * 37) % 40) * 86400 + ((ck * 131) % 24) * 3600
    base = F.coalesce(F.col("first_any_ts"), ts_lit(NO_ORDER_SIGNUP_BASE))
    customer = (cust_raw.join(first_ts, "customer_id", "left")
                .select(ck,
                        F.timestamp_add("SECOND", -back, base).alias("signup_ts"),
                        _map(F.col("c_mktsegment"), SEGMENT_CHANNEL).alias("acquisition_channel"),
                        F.when(ck % 3 == 0, "ios").otherwise("android").alias("platform"),
                        F.col("nationkey").alias("home_store_id")))

    # fact_app_events: shift to the order window, sessionise with a 12 h gap.
    ev = rd("events").select(
        F.col("event_id").cast("long").alias("event_id"),
        F.col("user_id").cast("long").alias("customer_id"),
        "event_type",
        (epoch_second("ts") - EVENT_SHIFT_DAYS * 86400).alias("t"))
    ev = sessionize(ev, "customer_id", "t", "event_id",
                    params.session_gap_seconds, params.session_bucket_seconds,
                    params.session_hot_bucket_rows, params.session_fine_seconds,
                    pieces(rd("events"), EVENTS_A_PIECE))
    uid = F.col("customer_id")
    ev = (ev.withColumn("session_id", uid * 100000 + F.col("session_idx"))
            .withColumn("event_ts", from_epoch_second(F.col("t")))
            .withColumn("platform", F.when(uid % 3 == 0, "ios").otherwise("android")))
    name = _map(F.col("event_type"), EVENT_NAMES)
    # a session's first event also opens the app: one pass, one explode
    real = F.struct(name.alias("event_name"),
                    F.when(name == "payment_success", F.col("event_id")).alias("order_id"))
    opened = F.struct(F.lit("app_open").alias("event_name"), F.lit(None).cast("long").alias("order_id"))
    both = F.when(F.col("is_session_start") == 1, F.array(opened, real)).otherwise(F.array(real))
    events = (ev.withColumn("e", F.explode(both))
                .select("session_id", "customer_id", "e.event_name", "event_ts", "platform", "e.order_id"))

    # fact_marketing_spend: cost per signup of each (signup month, channel).
    rate = _map(F.col("acquisition_channel"), CHANNEL_COST_PER_SIGNUP)
    spend = (customer.groupBy(month_start("signup_ts").alias("month_start"), "acquisition_channel")
             .agg(F.count(F.lit(1)).alias("signups"))
             .select("month_start", F.col("acquisition_channel").alias("channel"),
                     (F.col("signups") * rate).cast("long").alias("spend_inr")))

    return Star(store=store, product=product, customer=customer, orders=orders, items=items,
                events=events, spend=spend, params=params, pieces={"items": line_pieces})

