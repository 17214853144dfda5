"""Measures from written feeds, matrix totals and calendar slicers."""

import datetime as dt
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from growthlens.config import FIXTURES
from growthlens.operators.feed_store import Feeds
from growthlens.operators.feeds import write_feeds
from growthlens.operators.measures import MEASURES, measure_query
from growthlens.operators.order_parts import month_feed, sums_of_feed
from growthlens.plans.base import dim_date
from growthlens.sources.star import read_star, write_star
from growthlens.sources.tpch_adapter import tpch_star

SF = "/root/testdata/sf0.001"
D = dt.date
ORDER_MEASURES = [m for m, x in MEASURES.items() if x.fact == "orders"]
YEAR = {"month": (D(1999, 11, 1), D(2000, 10, 1))}


@pytest.fixture(scope="module")
def star(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    write_star(tpch_star(spark, SF, FIXTURES), path)
    return read_star(spark, path, "parquet", FIXTURES)


@pytest.fixture(scope="module")
def feeds(spark, star):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    write_feeds(star, path)
    return Feeds(spark, path, FIXTURES)


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df, kind="executedPlan"):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = getattr(df._jdf.queryExecution(), kind)().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return text


# ---- the feeds as source ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("by,filters,totals", [
    ([], {}, False), (["month"], {}, False), (["zone_name"], YEAR, True), (["acquisition_channel", "platform"], {}, True),
    (["month", "acquisition_channel"], YEAR | {"zone_name": ["NATION_1", "NATION_9", "NATION_15", "NATION_17"]}, False),
    (["year"], {"month_name": ["January", "May"]}, False), (["store_id"], {"acquisition_channel": "referral"}, False),
    (["capacity_profile"], {"month": D(1890, 1, 1)}, False), ([], {"month": D(1890, 1, 1)}, False)])
def test_order_measures_from_the_feed_equal_those_from_the_orders(star, feeds, by, filters, totals):
    names = [m for m in ORDER_MEASURES if not totals or not MEASURES[m].needs_month]
    names = [m for m in names if not ({"year"} & set(by)) or not MEASURES[m].needs_month]
    got = measure_query(feeds, names, by, filters, totals)
    want = measure_query(star, names, by, filters, totals)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("fact,by", [("customers", ["month", "zone_name"]), ("customers", ["rfm_segment", "is_weekend"]),
                                     ("funnel", ["month", "platform"]), ("marketing", ["year", "acquisition_channel"]),
                                     ("cohort", ["month_offset"])])
def test_other_measures_from_the_feeds(star, feeds, fact, by):
    names = [m for m, x in MEASURES.items() if x.fact == fact]
    assert rows(measure_query(feeds, names, by, totals=True)) == rows(measure_query(star, names, by, totals=True))


def test_a_slice_of_the_feed_scans_its_months_and_no_orders(feeds):
    text = plan(measure_query(feeds, ["active_customers", "active_customers_pm", "orders_per_active"], ["month"], YEAR))
    scans = re.findall(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/([^/\]]+)\]", text)
    assert set(scans) == {"feed_order_month"}, scans
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= 1999-11-01", text)


def test_feed_guards(feeds):
    for by in (["status"], ["rfm_segment"], ["order_date"], ["day_name"]):
        with pytest.raises(ValueError):
            measure_query(feeds, ["gmv"], by=by)


def test_bitmaps_count_ids_of_any_sign_and_size(spark):
    rnd = random.Random(5)
    ids = [0, 1, -1, 32768, 32769, -32768, -32769, 2 ** 62, -2 ** 62] + [rnd.randrange(-10 ** 6, 10 ** 6) for _ in range(200)]
    data = [(c, D(2000, 1 + k % 3, 1), k % 4, "delivered" if k % 5 else "cancelled", 10, None)
            for k, c in enumerate(ids * 2)]
    columns = ["item_total", "net_amount", "discount_amount", "contribution_rs", "item_margin", "is_on_time",
               "is_perfect_order", "is_late_5plus", "actual_delivery_min", "items_missing"]
    orders = spark.createDataFrame(data, "customer_id bigint, month date, store_id bigint, status string, one bigint, rating bigint")
    orders = orders.select("customer_id", "month", "store_id", "status", "rating", *[F.col("one").alias(c) for c in columns])
    customers = spark.createDataFrame([(c, "x" if c % 2 else "y", "ios") for c in set(ids)],
                                      "customer_id bigint, acquisition_channel string, platform string")
    feed = month_feed(orders, customers)
    for by in (["month"], ["store_id"], ["acquisition_channel"], ["month", "store_id"], []):
        got = {tuple(r[c] for c in by): r["m__act"] for r in sums_of_feed(feed, ["_act"], by, None).collect()}
        joined = orders.join(customers, "customer_id").where("status = 'delivered'")
        want = {tuple(r[c] for c in by): r.n for r in joined.groupBy(*by).agg(F.countDistinct("customer_id").alias("n")).collect()}
        assert {k: v for k, v in got.items() if v} == want, by


# ---- totals ----------------------------------------------------------------------------------------------------------

def test_every_level_of_a_matrix_is_its_own_measure_query(star):
    names = ["active_customers", "orders_per_active", "avg_rating", "gmv", "new_customers"]
    by = ["zone_name", "month"]
    got = measure_query(star, names, by, totals=True).collect()
    for kept in (by, by[:1], by[1:], []):
        level = [r for r in got if [c for c in by if not r[f"{c}_total"]] == kept]
        want = measure_query(star, names, kept).collect()
        assert sorted(map(repr, [[r[c] for c in kept + names] for r in level])) == sorted(
            map(repr, [[r[c] for c in kept + names] for r in want])), kept


def test_totals_of_chosen_levels_by_a_customer_attribute(star):
    got = measure_query(star, ["active_customers", "aov"], ["platform", "rfm_segment"], totals=[("platform",), ()]).collect()
    want = measure_query(star, ["active_customers", "aov"], ["platform"]).collect()
    assert {(r.platform, r.active_customers, r.aov) for r in got if not r.platform_total} == {tuple(r) for r in want}
    assert len([r for r in got if r.platform_total]) == 1 and {r.rfm_segment_total for r in got} == {1}


def test_totals_scan_each_fact_once_and_have_no_previous_month(star):
    text = plan(measure_query(star, ["active_customers", "gmv"], ["zone_name", "month"], totals=True))
    assert len(re.findall(r"FileScan parquet [^\n]*Location: [^\n]*/orders\]", text)) == 1
    with pytest.raises(ValueError):
        measure_query(star, ["gmv_pm"], ["month"], totals=True)


# ---- the calendar ----------------------------------------------------------------------------------------------------

def test_every_date_of_every_table_is_in_the_calendar(star):
    days = dim_date(star).select("date_key")
    for df, column in ((star.orders, "order_ts"), (star.customer, "signup_ts"), (star.events, "event_ts"),
                       (star.spend, "month_start")):
        dates = df.select(F.col(column).cast("date").alias("date_key"))
        assert dates.join(days, "date_key", "left_anti").isEmpty(), column


def test_calendar_slices_add_up_on_three_facts(star):
    names = ["delivered_orders", "new_customers", "sessions"]
    whole = measure_query(star, names).first()
    for by in (["day_of_week"], ["is_weekend"], ["week_start"], ["year_month"]):
        sums = measure_query(star, names, by).agg(*[F.sum(n).alias(n) for n in names]).first()
        assert sums == whole, by


def test_weekend_orders_are_those_of_saturday_and_sunday(star):
    got = measure_query(star, ["delivered_orders"], filters={"is_weekend": 1}).first()[0]
    o = star.orders.where("status = 'delivered'")
    assert got == o.where(F.weekday(F.col("order_ts").cast("date")) >= 5).count()


def test_a_calendar_filter_prunes_the_months_of_the_orders(star):
    df = measure_query(star, ["gmv"], ["week_start"], {"year": 2000})
    assert re.search(r"PartitionFilters: \[[^\]]*order_month#\d+[^\]]*dynamicpruning", plan(df)), plan(df)[:3000]
    want = star.orders.where((F.year("order_ts") == 2000) & (F.col("status") == "delivered")).agg(F.sum("item_total"))
    assert df.agg(F.sum("gmv")).first()[0] == want.first()[0]


@pytest.mark.parametrize("by", [[], ["zone_name"]])
def test_the_previous_month_is_whole_under_filters_on_days(star, by):
    def found(filters):
        return {tuple(r[c] for c in by): (r.gmv_pm, r.active_customers_pm) for r in measure_query(
            star, ["delivered_orders", "gmv_pm", "active_customers_pm"], by, filters).collect()}

    want = found({"month": D(2000, 2, 1)})
    for days in ((D(2000, 2, 1), D(2000, 2, 29)), (D(2000, 2, 3), D(2000, 2, 9)), D(2000, 2, 10), [D(2000, 2, 10)]):
        got = found({"order_date": days})
        assert all(want[k] == v for k, v in got.items()) and (got or by), days
    got = found({"month": D(2000, 2, 1), "is_weekend": 0})
    assert got and all(want[k] == v for k, v in got.items())


def test_the_previous_month_by_month_under_filters_on_days(star):
    whole = {r.month: r.gmv for r in measure_query(star, ["gmv"], ["month"]).collect()}
    shown = measure_query(star, ["gmv", "gmv_pm"], ["month"], {"order_date": (D(2000, 2, 10), D(2000, 4, 2))}).collect()
    assert {r.month for r in shown} <= {D(2000, 2, 1), D(2000, 3, 1), D(2000, 4, 1)} and shown
    for r in shown:
        assert r.gmv_pm == whole.get((r.month - dt.timedelta(days=1)).replace(day=1))
    with pytest.raises(ValueError):
        measure_query(star, ["gmv_pm"], ["day_name"])
