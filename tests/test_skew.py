"""One customer owns a third of all orders and app events, one part a third of
all order lines: Spark == DuckDB oracle.

The skewed inputs are derived from the driver's sf0.001 tables: every third
order (by key) and every third event (by id) is handed to one customer, every
third line item to one part.  Automatic broadcasts are off and AQE treats tiny
partitions as skewed, so the plans must cope with the hot keys themselves:
partial aggregates before joins, bucketed sessionisation, distributed NTILE
and the hot-key branch of ``join_per_key``.
"""

import os
import shutil
import tempfile

import duckdb
import pytest

from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from growthlens.sources.tpch_adapter import tpch_star
from oracle.queries import statements
from tools.check_oracle import TABLES, digest

SRC = "/root/testdata/sf0.001"
HOT = 7
# thresholds at which the hot customer, the hot part and busy (user, hour) cells of these small tables are split
LOW = FIXTURES.with_(hot_key_rows=200, session_hot_bucket_rows=1)
SQL = statements(LOW)
HOT_PART = 11

NAMES = [
    "orders_delivered", "customer_first", "session_funnel", "first_session_depth",
    "cac_payback", "channel_scorecard", "margin_by_tenure", "high_margin_attach",
    "cart_checkout_by_zone_period", "feed_funnel_monthly", "repeat_after_first_order",
    "reactivation", "growth_accounting", "reorder_by_rating", "repeat_vs_on_time",
    "customer_rfm", "customer_health", "lifecycle_snapshot", "net_revenue_by_segment",
    "m1_by_buyer_type", "heart_monthly", "monthly_kpis", "dq_audit", "churn_by_first_experience",
    "bad_first_opportunity", "order_margin", "category_mix", "product_health", "feed_dim_product",
    "product_review_list",
]

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@pytest.fixture(scope="module")
def skewed_dir():
    out = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    con = duckdb.connect()
    for t in TABLES:
        src = f"{SRC}/{t}.parquet"
        if not os.path.exists(src):
            continue
        dst = f"{out}/{t}.parquet"
        if t == "orders":
            sel = (f"SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN {HOT} ELSE o_custkey END AS o_custkey) "
                   f"FROM read_parquet('{src}')")
        elif t == "lineitem":
            sel = (f"SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN {HOT_PART} "
                   f"ELSE l_partkey END AS l_partkey) FROM read_parquet('{src}')")
        elif t == "events":
            sel = (f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN {HOT} ELSE user_id END AS user_id) "
                   f"FROM read_parquet('{src}')")
        else:
            shutil.copyfile(src, dst)
            continue
        con.execute(f"COPY ({sel}) TO '{dst}' (FORMAT PARQUET)")
    return out


@pytest.fixture(scope="module")
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con(skewed_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{skewed_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_hot_customer_really_is_hot(con):
    n, hot = con.execute(f"SELECT count(*), count(*) FILTER (WHERE o_custkey = {HOT}) FROM orders").fetchone()
    assert hot * 3 >= n
    n, hot = con.execute(f"SELECT count(*), count(*) FILTER (WHERE user_id = {HOT}) FROM events").fetchone()
    assert hot * 3 >= n
    n, hot = con.execute(f"SELECT count(*), count(*) FILTER (WHERE l_partkey = {HOT_PART}) FROM lineitem").fetchone()
    assert hot * 4 >= n


@pytest.mark.parametrize("name", NAMES)
def test_skewed_query_matches_oracle(skew_session, con, skewed_dir, name):
    df = QUERIES[name](tpch_star(skew_session, skewed_dir, LOW))
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    orows = res.fetchall()
    sc, sk, sh = digest(df.columns, srows)
    oc, ok, oh = digest([c[0] for c in res.description], orows)
    assert sc == oc
    assert len(srows) == len(orows)
    assert sh == oh, sorted(set(sk) ^ set(ok), key=repr)[:4]


def test_join_per_key_equals_plain_join(spark):
    from pyspark.sql import functions as F

    from growthlens.plans.skew import join_per_key

    rows = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("v"))
    per_key = spark.range(0, 90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        got = join_per_key(rows, per_key, "k", 100, how)
        exp = rows.join(per_key, "k", how)
        assert sorted(got.collect()) == sorted(exp.select(*got.columns).collect()), how
    # NULL keys: dropped by inner, kept with NULL partners by left, never shuffled together
    with_nulls = rows.unionByName(spark.range(0, 500).select(F.lit(None).cast("long").alias("k"),
                                                             (F.col("id") + 10_000).alias("v")))
    for how in ("inner", "left"):
        got = join_per_key(with_nulls, per_key, "k", 100, how)
        exp = with_nulls.join(per_key, "k", how)
        assert sorted(got.collect(), key=repr) == sorted(exp.select(*got.columns).collect(), key=repr), how
    # a supplied hot list (too wide or empty) changes the branch, never the result
    dup = spark.range(0, 20).select((F.col("id") % 7).alias("k"))  # repeated keys must not repeat rows
    for hot in (spark.range(0, 20).select(F.col("id").alias("k")), spark.range(0).select(F.col("id").alias("k")), dup):
        got = join_per_key(rows, per_key, "k", 100, "left", hot=hot)
        assert sorted(got.collect()) == sorted(rows.join(per_key, "k", "left").select(*got.columns).collect())
    # key 5 (a third of the rows) is joined by broadcast, without shuffling its rows
    plan = join_per_key(rows, per_key, "k", 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["channel_scorecard", "dq_audit"])
def test_hot_customer_rows_skip_the_shuffle_join(skew_session, skewed_dir, name):
    """On the skewed tables the hot customer is found and joined through the broadcast branch."""
    from growthlens.plans.base import orders_delivered
    from growthlens.plans.skew import hot_keys

    star = tpch_star(skew_session, skewed_dir, LOW)
    hot = [r.customer_id for r in hot_keys(orders_delivered(star), "customer_id", LOW.hot_key_rows).collect()]
    assert hot == [HOT]
    df = QUERIES[name](star)
    df.collect()
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_part_is_found_on_order_lines(skew_session, skewed_dir):
    from growthlens.plans.skew import hot_keys

    star = tpch_star(skew_session, skewed_dir, LOW)
    hot = [r.product_id for r in hot_keys(star.items, "product_id", LOW.hot_key_rows).collect()]
    assert hot == [HOT_PART]
