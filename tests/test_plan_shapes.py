"""Physical-plan properties the scale design relies on."""

import re

import pytest
from pyspark.sql import functions as F

from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from growthlens.plans.base import customer_first, first_orders
from growthlens.plans.ntile import distributed_ntiles
from growthlens.sources.tpch_adapter import tpch_star

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return tpch_star(spark, SF, FIXTURES)


def test_first_order_is_an_aggregate_not_a_customer_window(star):
    p = plan(first_orders(star))
    assert "Window" not in p
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p
    assert "Window" not in plan(customer_first(star).select("customer_id", "first_order_ts"))


def test_ntile_moves_only_offsets_through_one_partition(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    out = distributed_ntiles(df, "id", {"t": F.col("v"), "u": -F.col("v")}, 5)
    out.collect()
    p = plan(out)
    # the only single-partition exchange is the offsets frame (one row per partition), broadcast back
    assert "BroadcastExchange" in p
    assert "ntile" not in p.lower()


def test_no_cartesian_products(star):
    for name in ("high_margin_attach", "measure_totals", "dq_audit", "lifecycle_snapshot", "heart_monthly"):
        p = QUERIES[name](star)._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in p and "CartesianProduct" not in p, name


@pytest.mark.parametrize("name", ["cac_payback", "margin_by_tenure", "high_margin_attach",
                                  "cart_checkout_by_zone_period", "feed_funnel_monthly"])
def test_order_and_session_rows_are_summed_per_customer_month_before_the_customer_join(spark, name):
    """A customer owning a third of all orders reaches the customer join as one row per month."""
    from tests.helpers import star_from_rows

    small = star_from_rows(spark)
    p = QUERIES[name](small)._jdf.queryExecution().optimizedPlan().toString()
    lines = p.splitlines()
    joins = [i for i, ln in enumerate(lines) if "Join Inner" in ln and "customer_id" in ln]
    assert joins, name
    below = "\n".join(lines[joins[0]:])
    assert re.search(r"Aggregate \[customer_id#\d+L?, (order|session)_month#", below), name


@pytest.mark.parametrize("name", ["category_mix", "high_margin_attach"])
def test_order_lines_are_summed_per_product_before_the_product_join(spark, name):
    """Lines meet the product table as one row per product (and month), not one per line."""
    from tests.helpers import star_from_rows

    p = QUERIES[name](star_from_rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    lines = p.splitlines()
    joins = [i for i, ln in enumerate(lines) if "Join" in ln and "product_id" in ln and "order_id" not in ln]
    assert joins, name
    assert any(re.search(r"Aggregate \[product_id#", "\n".join(lines[i:])) for i in joins), name


def test_product_weeks_are_bits_not_a_second_distinct_count(star):
    """One distinct count in the aggregate over order lines: they are not expanded."""
    p = QUERIES["product_health"](star)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in p and "bit_or" in p
