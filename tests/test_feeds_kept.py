"""Feeds written together: the order lines are summed once, bitmaps are built where they are written."""

import datetime as dt

import pytest

from growthlens.operators.feed_store import with_orders_kept
from growthlens.operators.feeds import feed_dim_customer, feed_marketing, feed_order_month
from tests.helpers import customer, order, star_from_rows, stores

FEEDS = ["feed_order_month", "feed_dim_customer", "feed_marketing"]


@pytest.fixture()
def star(spark):
    day = dt.datetime(2001, 5, 1)
    rows = {
        "store": stores(), "product": [(i, f"P{i}", "A", 100, 60 + i, 0) for i in range(1, 4)],
        "customer": [customer(c, dt.datetime(2001, 4, 1) + dt.timedelta(days=c)) for c in range(1, 31)],
        # order 5 comes twice, order 7 has no lines, customer 40 is not known
        "orders": [order(i, 1 + i % 30, day + dt.timedelta(days=i), status="cancelled" if i % 9 == 0 else "delivered",
                         rating=5 if i % 2 else None) for i in [*range(1, 60), 5]] + [order(90, 40, day)],
        "items": [(i, p, 2, 100, 200) for i in range(1, 60) if i != 7 for p in (1, 2)] + [(8, 99, 1, 10, 10)]}
    return star_from_rows(spark, **rows)


def test_kept_orders_give_the_same_feeds_without_the_lines(star, scratch):
    kept = with_orders_kept(star, scratch, FEEDS)
    for feed in (feed_order_month, feed_dim_customer, feed_marketing):
        assert sorted(map(repr, feed(kept).collect())) == sorted(map(repr, feed(star).collect())), feed.__name__
    for feed in (feed_order_month, feed_dim_customer):
        read = feed(kept)._jdf.queryExecution().analyzed().toString()
        assert "line_amount" not in read and "FileScan" in feed(kept)._jdf.queryExecution().executedPlan().toString()


def test_one_feed_of_orders_keeps_nothing(star, scratch):
    assert with_orders_kept(star, scratch, ["feed_order_month", "feed_dim_store"]) is star


def test_bitmaps_of_customers_are_not_shuffled(star):
    p = feed_order_month(star)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(month#" in p
    above = p[:p.index("rangepartitioning(month#")]
    assert "bitmap_construct_agg" in above and above.count("Exchange") == 1, above
