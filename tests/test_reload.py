"""Reload by month: only changed months are written, and the result is that of a full load."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from growthlens.operators.feeds import FEEDS, feed_partition, write_feeds
from growthlens.sources.reload import reload_feeds, reload_star
from growthlens.sources.star import SCHEMAS, Star, load_row_counts, read_star, write_star
from growthlens.sources.tpch_adapter import tpch_star

from .helpers import customer, order, star_from_rows, stores

SF = "/root/testdata/sf0.001"
D, T = dt.date, dt.datetime
MONTH = D(2000, 6, 1)


@pytest.fixture(scope="module")
def star(spark):
    return tpch_star(spark, SF, FIXTURES)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def one_month(star, month, change=None):
    """A delivery of one month of the facts; ``change`` alters its orders."""
    orders = star.orders.where(F.trunc(F.col("order_ts").cast("date"), "month") == F.lit(month))
    items = star.items.join(orders.select("order_id"), "order_id", "left_semi")
    events = star.events.where(F.trunc(F.col("event_ts").cast("date"), "month") == F.lit(month))
    orders = change(orders) if change else orders
    return Star(store=star.store, product=star.product, customer=star.customer, orders=orders, items=items,
                events=events, spend=star.spend, params=star.params)


def dearer(orders, month=MONTH):
    """The orders of the month are dearer and were promised later."""
    there = F.trunc(F.col("order_ts").cast("date"), "month") == F.lit(month)
    return orders.withColumns({c: F.col(c) + F.when(there, n).otherwise(0) for c, n in (("item_total", 7), ("promised_min", 60))})


def tables(star):
    return {k: sorted(map(repr, df.select(SCHEMAS[k].names).collect())) for k, df in star.tables().items()}


def test_one_month_is_rewritten_and_nothing_else(spark, star, scratch):
    path, feeds, whole = f"{scratch}/star", f"{scratch}/feeds", f"{scratch}/whole"
    write_star(star, path)
    write_feeds(read_star(spark, path, "parquet", FIXTURES), feeds)
    before, before_feeds = files(path), files(feeds)

    assert not any(reload_star(one_month(star, MONTH), path).values())
    assert files(path) == before

    changed = reload_star(one_month(star, MONTH, dearer), path)
    assert {k: v for k, v in changed.items() if v} == {"orders": [MONTH]}
    moved = {f for f, t in files(path).items() if before.get(f) != t} | set(before) - set(files(path))
    assert moved and all("/orders/order_month=2000-06-01/" in f or "/load_row_counts/" in f for f in moved)

    # a full load of the same data gives the same star and the same feeds
    full = Star(**(star.tables() | {"orders": dearer(star.orders)}), params=FIXTURES)
    write_star(full, whole)
    back, other = (read_star(spark, p, "parquet", FIXTURES) for p in (path, whole))
    assert tables(back) == tables(other)

    written = reload_feeds(back, feeds, changed)
    moved = {f for f, t in files(feeds).items() if before_feeds.get(f) != t}
    for name in ("feed_fact_orders", "feed_order_month", "feed_store_month_ops"):
        assert written[name] == [MONTH]
        assert all(f"{feed_partition(name)}=2000-06-01" in f for f in moved if f"/{name}/" in f)
    assert written["feed_dim_store"] == written["feed_funnel_monthly"] == written["feed_marketing"] == []
    for name in FEEDS:
        got = spark.read.parquet(f"{feeds}/{name}")
        want = FEEDS[name](other)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())), name
    assert not any(v for k, v in reload_feeds(back, feeds, changed).items())


def test_a_new_month_is_added_and_counted(spark, star, scratch):
    early = star.orders.where(F.col("order_ts") < F.lit("2001-06-01").cast("timestamp_ntz"))
    lines = star.items.join(early.select("order_id"), "order_id", "left_semi")
    old_events = star.events.where(F.col("event_ts") < F.lit("2001-06-01").cast("timestamp_ntz"))
    write_star(Star(**(star.tables() | {"orders": early, "items": lines, "events": old_events}), params=FIXTURES), scratch)
    for month in (D(2001, 6, 1), D(2001, 7, 1), D(2001, 8, 1), D(2001, 9, 1)):
        reload_star(one_month(star, month), scratch)
    back = read_star(spark, scratch, "parquet", FIXTURES)
    assert tables(back) == tables(star)
    counts = load_row_counts(back)
    assert "orders" not in counts._jdf.queryExecution().executedPlan().toString()  # from the load, without a scan
    assert sorted(counts.collect()) == sorted(load_row_counts(star).collect())


def test_a_dimension_is_replaced_whole(spark, star, scratch):
    write_star(star, scratch)
    delivery = one_month(star, MONTH)
    delivery.store = star.store.withColumn("city", F.concat("city", F.lit("!")))
    changed = reload_star(delivery, scratch)
    assert {k: v for k, v in changed.items() if v} == {"store": [None]}
    assert sorted(map(repr, read_star(spark, scratch, "parquet", FIXTURES).store.collect())) == sorted(
        map(repr, delivery.store.collect()))


@pytest.mark.parametrize("first", [0, 1])
def test_lines_of_a_repeated_order_id_lie_in_its_last_month(spark, scratch, first):
    """Two orders of one id in two months: the written star answers as the built one, whatever their order."""
    pair = [order(1, 1, T(1996, 2, 3), item_total=500), order(1, 1, T(2001, 6, 3), item_total=500)]
    small = star_from_rows(
        spark, store=stores(), product=[(1, "p", "Tea", 100, 60, 0)], customer=[customer(1, T(1995, 1, 1))],
        orders=[pair[first], pair[1 - first], order(2, 1, T(2001, 7, 1))], items=[(1, 1, 5, 100, 500), (2, 1, 1, 100, 100)])
    write_star(small, scratch)
    back = read_star(spark, scratch, "parquet", FIXTURES)
    assert [r.order_month for r in back.by_month["items"].orderBy("order_id").collect()] == [D(2001, 6, 1), D(2001, 7, 1)]
    for name in ("product_health", "category_mix"):
        assert sorted(map(repr, QUERIES[name](back).collect())) == sorted(map(repr, QUERIES[name](small).collect()))
