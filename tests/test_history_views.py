"""Customer history as bit sets, and the datasets as SQL views."""

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from growthlens import views
from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from growthlens.operators.feed_store import Feeds, with_history
from growthlens.operators.feeds import write_feeds
from growthlens.plans.base import orders_delivered
from growthlens.plans.history import active_months, merged, month_bits
from growthlens.sources.star import read_star, write_star
from growthlens.sources.tpch_adapter import tpch_star

from .helpers import customer, order, star_from_rows, stores

SF = "/root/testdata/sf0.001"
D, T = dt.date, dt.datetime
RETENTION = ["retention_triangle", "retention_m1_m3_m6", "retention_curve", "retention_matrix", "m1_by_channel",
             "blended_retention", "cohort_activity"]


@pytest.fixture(scope="module")
def star(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    write_star(tpch_star(spark, SF, FIXTURES), path)
    return read_star(spark, path, "parquet", FIXTURES)


@pytest.fixture(scope="module")
def kept(spark, star):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    write_feeds(star, path, ["feed_customer_months"])
    return with_history(star, Feeds(spark, path, FIXTURES))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_bits_name_the_months_of_any_span(spark):
    months = [D(1, 1, 1), D(1969, 12, 1), D(1970, 1, 1), D(2000, 8, 1), D(2000, 9, 1), D(2026, 3, 1), D(9999, 12, 1)]
    data = [(c, m) for c in (-5, 0, 7) for k, m in enumerate(months) if (c + k) % 3] * 4
    orders = spark.createDataFrame(data, "customer_id bigint, order_month date").repartition(5)
    bits = month_bits(orders)
    assert sorted((r.customer_id, r.order_month) for r in active_months(bits).collect()) == sorted(set(data))
    assert bits.groupBy("customer_id", "word").count().where("count > 1").isEmpty()
    edges = spark.createDataFrame([(1, D(5, 4, 1)), (1, D(5, 5, 1))], "customer_id bigint, order_month date")
    assert {r.order_month for r in active_months(month_bits(edges)).collect()} == {D(5, 4, 1), D(5, 5, 1)}


def test_adding_a_month_is_an_or(star):
    od = orders_delivered(star).select("customer_id", "order_month")
    old, new = od.where("order_month < '2000-01-01'"), od.where("order_month >= '2000-01-01'")
    again = od.where("order_month between '1999-11-01' and '2000-02-01'")
    assert rows(merged(month_bits(old), month_bits(new), month_bits(again))) == rows(month_bits(od))


@pytest.mark.parametrize("name", RETENTION)
def test_retention_from_the_history_equals_that_from_the_orders(star, kept, name):
    df = QUERIES[name](kept)
    assert rows(df) == rows(QUERIES[name](star))
    if name != "cohort_activity":
        scans = set(re.findall(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/([^/\]]+)\]",
                               df._jdf.queryExecution().executedPlan().toString()))
        assert scans <= {"feed_customer_months", "customers"}, scans


def test_growth_accounting_tells_new_retained_and_returning_customers(spark):
    def o(n, c, month, total):
        return order(n, c, T(2000, month, 5), item_total=total)

    small = star_from_rows(spark, store=stores(), customer=[customer(c, T(1999, 1, 1)) for c in (1, 2)],
                           orders=[o(1, 1, 1, 10), o(2, 1, 2, 20), o(3, 1, 4, 40), o(4, 2, 2, 7), o(5, 2, 2, 5),
                                   o(6, 9, 4, 3), order(7, 1, T(2000, 3, 5), status="cancelled", item_total=99)])
    got = {r.order_month.month: tuple(r)[1:] for r in QUERIES["growth_accounting"](small).collect()}
    assert got == {1: (10, 0, 0, 10), 2: (12, 20, 0, 32), 4: (3, 0, 40, 43)}


# ---- views -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["orders_delivered", "customer_first", "order_margin", "session_funnel", "cohort_activity",
                                  "monthly_kpis", "rfm_summary", "store_month_ops", "product_health", "feed_dim_customer",
                                  "feed_marketing", "customer_health", "dim_date"])
def test_datasets_answer_by_name(star, name):
    assert rows(views.sql(star, f"SELECT * FROM {name}")) == rows(QUERIES[name](star))


def test_statements_join_datasets_and_loaded_tables(star):
    got = views.sql(star, """
        SELECT s.zone_name, count(*) AS n, sum(m.contribution_rs) AS c
        FROM order_margin m JOIN dim_store s USING (store_id) WHERE m.order_month >= :since GROUP BY 1""",
                    args={"since": D(2000, 1, 1)})
    want = QUERIES["order_margin"](star).where("order_month >= '2000-01-01'").join(star.store, "store_id").groupBy(
        "zone_name").agg(F.count(F.lit(1)).alias("n"), F.sum("contribution_rs").alias("c"))
    assert rows(got) == rows(want)


def test_views_take_named_parameters(star):
    early = views.sql(star, "SELECT max(order_month) AS last FROM monthly_kpis", as_of=D(1999, 6, 30)).first().last
    assert early == D(1999, 6, 1)
    assert views.sql(star, "SELECT max(order_month) AS last FROM monthly_kpis").first().last > early
    with pytest.raises(KeyError):
        views.sql(star, "SELECT 1", as_off=D(2000, 1, 1))


def test_filters_of_a_statement_prune_months(star, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df = views.sql(star, "SELECT count(*) FROM orders_delivered WHERE order_month = DATE '2000-03-01'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*order_month#\d+ = 2000-03-01", plan)


def test_every_name_is_registered_once():
    names = views.datasets()
    assert len(names) == len(set(names)) and set(QUERIES) < set(names)
