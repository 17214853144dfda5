"""CSV/parquet star round trip, row counts, dim_date and the measure layer."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from growthlens.operators.measures import measure_query
from growthlens.plans.base import dim_date
from growthlens.sources.star import FILE_NAMES, load_row_counts, read_star, write_star
from growthlens.sources.tpch_adapter import tpch_star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return tpch_star(spark, SF, FIXTURES)


def test_csv_round_trip(spark, star, scratch):
    for key, df in star.tables().items():
        (df.coalesce(1).write.mode("overwrite").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{scratch}/{FILE_NAMES[key]}"))
    back = read_star(spark, scratch, "csv", FIXTURES)
    for key, df in star.tables().items():
        a = sorted(map(repr, df.collect()))
        b = sorted(map(repr, getattr(back, key).collect()))
        assert a == b, key


def test_parquet_round_trip_and_counts(spark, star, scratch):
    write_star(star, scratch)
    back = read_star(spark, scratch, "parquet", FIXTURES)
    got = {r.table_name: r.rows_loaded for r in load_row_counts(back).collect()}
    exp = {r.table_name: r.rows_loaded for r in load_row_counts(star).collect()}
    assert got == exp


def test_dim_date_monday_is_zero(star):
    dd = dim_date(star)
    r = dd.filter(F.col("date_key") == F.lit(dt.date(2001, 7, 2))).first()  # a Monday
    assert (r.day_of_week, r.day_name, r.is_weekend, r.week_start) == (0, "Monday", 0, dt.date(2001, 7, 2))
    ends = [d for df, c in ((star.orders, "order_ts"), (star.customer, "signup_ts"), (star.events, "event_ts"),
                            (star.spend, "month_start")) for d in df.agg(F.min(c).cast("date"), F.max(c).cast("date")).first()]
    first, last = dd.agg(F.min("date_key"), F.max("date_key")).first()
    assert first.day == 1 and first == (min(ends).replace(day=1) - dt.timedelta(days=1)).replace(day=1)
    assert (last + dt.timedelta(days=1)).day == 1 and 28 <= (last - max(ends).replace(day=1)).days <= 62
    assert dd.count() == (last - first).days + 1


def test_measure_totals_equal_direct_aggregates(star):
    m = measure_query(star, ["gmv", "delivered_orders", "active_customers", "sessions", "signups"]).first()
    od = star.orders.filter(F.col("status") == "delivered")
    assert m.gmv == od.agg(F.sum("item_total")).first()[0]
    assert m.delivered_orders == od.count()
    assert m.active_customers == od.select("customer_id").distinct().count()
    assert m.signups == star.customer.count()


def test_measures_slice_and_recombine(star):
    by_zone = measure_query(star, ["gmv"], by=["zone_name"]).agg(F.sum("gmv")).first()[0]
    total = measure_query(star, ["gmv"]).first().gmv
    assert by_zone == total


def test_measure_guards(star):
    with pytest.raises(ValueError):
        measure_query(star, ["sessions"], by=["zone_name"])
    # neither a month nor a month filter: no previous month
    assert {r.gmv_pm for r in measure_query(star, ["gmv_pm"], by=["zone_name"]).collect()} == {None}
    with pytest.raises(KeyError):
        measure_query(star, ["nope"])


@pytest.mark.parametrize("name", ["product_health", "ops_pooled_stressed_vs_other", "cohort_activity",
                                  "customer_health", "feed_fact_orders", "dq_audit"])
def test_persisted_star_gives_same_answers(spark, star, scratch, name):
    from growthlens.catalog import QUERIES
    write_star(star, scratch)
    back = read_star(spark, scratch, "parquet", FIXTURES)
    a = sorted(map(repr, QUERIES[name](star).collect()))
    b = sorted(map(repr, QUERIES[name](back).collect()))
    assert a == b


def test_customer_sliced_order_measures_equal_order_grain_join(star):
    """Pre-aggregated (customer, slice) path == joining every order to its customer."""
    from growthlens.operators.feeds import feed_fact_orders

    keep = ["referral", "paid_search"]
    got = measure_query(star, ["gmv", "active_customers", "delivered_orders", "avg_rating", "gmv_pm",
                               "active_customers_pm", "cancellation_pct"],
                        by=["month", "acquisition_channel"], filters={"acquisition_channel": keep})
    o = (feed_fact_orders(star).withColumn("month", F.trunc("order_date", "month"))
         .join(star.customer.select("customer_id", "acquisition_channel"), "customer_id", "left")
         .filter(F.col("acquisition_channel").isin(keep)))
    dlv = F.col("status") == "delivered"
    exp = (o.groupBy("month", "acquisition_channel")
           .agg(F.sum(F.when(dlv, F.col("item_total"))).alias("gmv"),
                F.countDistinct(F.when(dlv, F.col("customer_id"))).alias("act"),
                F.count(F.when(dlv, 1)).alias("n"), F.count(F.lit(1)).alias("all"))
           .collect())
    g = {(r.month, r.acquisition_channel): r for r in got.collect()}
    assert len(g) == len(exp) > 0
    for r in exp:
        m = g[(r.month, r.acquisition_channel)]
        assert (m.gmv, m.active_customers, m.delivered_orders) == (r.gmv, r.act, r.n)
        prev = [x for x in exp if x.acquisition_channel == r.acquisition_channel
                and x.month == (r.month.replace(year=r.month.year - 1, month=12) if r.month.month == 1
                                else r.month.replace(month=r.month.month - 1))]
        assert m.gmv_pm == (prev[0].gmv if prev else None)
        assert m.active_customers_pm == (prev[0].act if prev else None)


def test_write_feeds_round_trip(spark, star, scratch):
    from growthlens.operators.feeds import FEEDS, write_feeds

    paths = write_feeds(star, scratch)
    assert set(paths) == set(FEEDS)
    for name in ("feed_fact_orders", "feed_funnel_monthly", "feed_dim_customer"):
        back = spark.read.parquet(paths[name])
        exp = FEEDS[name](star)
        cols = exp.columns
        assert sorted(map(repr, back.select(*cols).collect())) == sorted(map(repr, exp.collect())), name
    months = spark.read.parquet(paths["feed_fact_orders"]).select("order_month").distinct().count()
    assert months == FEEDS["feed_fact_orders"](star).select(F.trunc("order_date", "month")).distinct().count()


def test_month_filter_on_order_measures_prunes_partitions(spark, star, scratch):
    write_star(star, scratch)
    back = read_star(spark, scratch, "parquet", FIXTURES)
    q = measure_query(back, ["gmv", "on_time_pct"], by=["zone_name"],
                      filters={"month": (dt.date(2000, 1, 1), dt.date(2000, 6, 1))})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # filters are cut short in plans otherwise
    plan = q._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # the slicer's lower bound reaches the orders scan as a partition filter
    assert re.search(r"PartitionFilters: \[[^\]]*order_month#\d+ >= 2000-01-01", plan), plan[:3000]
    same = measure_query(star, ["gmv", "on_time_pct"], by=["zone_name"],
                         filters={"month": (dt.date(2000, 1, 1), dt.date(2000, 6, 1))})
    assert sorted(map(repr, q.collect())) == sorted(map(repr, same.collect()))


def test_first_filtered_month_keeps_its_previous_month(star):
    lo, hi = dt.date(2000, 1, 1), dt.date(2000, 6, 1)
    whole = {r.month: r.gmv for r in measure_query(star, ["gmv"], by=["month"]).collect()}
    shown = measure_query(star, ["gmv", "gmv_pm"], by=["month"], filters={"month": (lo, hi)}).collect()
    assert {r.month for r in shown} == {m for m in whole if lo <= m <= hi}
    for r in shown:
        before = (r.month - dt.timedelta(days=1)).replace(day=1)
        assert r.gmv_pm == whole.get(before)
    card = measure_query(star, ["gmv", "gmv_pm"], filters={"month": lo}).first()
    assert (card.gmv, card.gmv_pm) == (whole[lo], whole[dt.date(1999, 12, 1)])


def test_retention_pools_every_observable_cohort(star):
    curve = {r.month_offset: r.retention_pct for r in measure_query(
        star, ["retention_pct"], by=["month_offset"]).collect()}
    pooled = QUERIES["blended_retention"](star).first()
    assert (curve[1], curve[3], curve[6]) == (pooled.m1_pct, pooled.m3_pct, pooled.m6_pct)
    assert measure_query(star, ["cohort_size"]).first().cohort_size == star.customer.count()


def test_one_as_of_bounds_measures_and_kpis_alike(spark):
    early = tpch_star(spark, SF, FIXTURES.with_(as_of=dt.date(1999, 12, 31)))
    gmv = measure_query(early, ["gmv"]).first().gmv
    assert gmv == QUERIES["monthly_kpis"](early).agg(F.sum("gmv_rs")).first()[0]


def test_order_measures_without_margin_leave_the_lines_unread(spark, scratch, star):
    write_star(star, scratch)
    stored = read_star(spark, scratch, "parquet", FIXTURES)
    for name in ("measures_by_month", "measures_by_month_zone", "zone_ops_since_stress"):
        plan = QUERIES[name](stored)._jdf.queryExecution().optimizedPlan().toString()
        assert "line_amount" not in plan, name


def test_parquet_without_a_month_column_is_read(spark, scratch, star):
    for key, df in star.tables().items():
        df.write.parquet(f"{scratch}/{FILE_NAMES[key].rsplit('.', 1)[0]}")
    back = read_star(spark, scratch, "parquet", FIXTURES)
    months = back.orders.select("order_month").distinct().count()
    assert months == star.orders.select(F.trunc(F.col("order_ts").cast("date"), "month")).distinct().count()


def test_all_three_facts_prune_months(spark, star, scratch):
    from growthlens.plans.base import events_as_of, items_since

    write_star(star, scratch)
    stored = read_star(spark, scratch, "parquet", FIXTURES)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in (
        ("items", items_since(stored, dt.date(2000, 1, 15))), ("events", events_as_of(stored)))}
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*order_month#\d+ >= 2000-01-01", plans["items"])
    assert re.search(r"PartitionFilters: \[[^\]]*event_month#\d+ <= 2001-08-01", plans["events"])
    for df in (stored.items, stored.events):
        assert "order_month" not in df.columns and "event_month" not in df.columns
    assert sorted(map(repr, QUERIES["product_health"](stored).collect())) == sorted(
        map(repr, QUERIES["product_health"](star).collect()))
    assert sorted(map(repr, stored.items.collect())) == sorted(map(repr, star.items.collect()))
