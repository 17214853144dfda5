"""Shuffles of narrow rows are dealt by the number of rows, so that the memory of a task does not grow with the table."""

import re

from pyspark.sql import functions as F

import growthlens.plans.ntile as ntile
import growthlens.sources.tpch_adapter as adapter
from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from growthlens.plans.sessionize import sessionize
from growthlens.plans.skew import pieces
from growthlens.sources.tpch_adapter import tpch_star
from tests.helpers import T, customer, order, star_from_rows

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_grow_with_the_rows(spark, scratch):
    cores = spark.sparkContext.defaultParallelism
    for rows, expected in ((0, cores), (30, cores), (1001, 101)):
        spark.range(rows).write.mode("overwrite").parquet(f"{scratch}/t")
        assert pieces(spark.read.parquet(f"{scratch}/t"), 10) == expected, rows


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(adapter, "LINES_A_PIECE", 100)
    expected = -(-lines // 100)
    star = tpch_star(spark, SF, FIXTURES)
    for name in ("category_mix", "product_health", "high_margin_attach", "dq_key_integrity"):
        dealt = re.findall(r"hashpartitioning\(order_id#\d+L, (\d+)\), REPARTITION", plan(QUERIES[name](star)))
        assert dealt and set(dealt) == {str(expected)}, (name, dealt)


def test_session_windows_are_dealt_by_pieces_and_summaries_not_broadcast(spark):
    ev = spark.range(3000).select((F.col("id") % 7).alias("u"), (F.col("id") * 977 % 90_000).alias("t"), "id")
    whole = sessionize(ev, "u", "t", "id", 3600, 900)
    dealt = sessionize(ev, "u", "t", "id", 3600, 900, pieces=11)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
    p = plan(dealt)
    assert re.search(r"hashpartitioning\(u#\d+L, _bk#\d+L, 11\)", p) and "BroadcastHashJoin" not in p, p


def test_ranks_are_dealt_by_the_number_of_products_and_customers(spark, monkeypatch):
    asked, frame = [], type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: asked.append(n) or deal(self, n, *cols))
    monkeypatch.setattr(ntile, "RANKS_A_RANGE", 12)
    cores = spark.sparkContext.defaultParallelism
    products = [(i, f"p{i}", f"c{i % 3}", 100, 60, 0) for i in range(50 * cores)]
    people = [customer(i, T(1998, 7, 1)) for i in range(40 * cores)]
    star = star_from_rows(
        spark, product=products, customer=people, orders=[order(1, 1, T(1998, 7, 20))], items=[(1, 7, 2, 100, 200)])
    tiers = QUERIES["product_tier_mix"](star).collect()
    assert sum(r.star + r.solid + r.watch + r.review for r in tiers) == 50 * cores
    assert [r.product_id for r in QUERIES["product_review_list"](star).collect()] != []
    assert len(QUERIES["customer_rfm"](star).collect()) == 1
    # four scores of a product, three of a customer, 12 in a range
    assert set(asked) == {-(-50 * cores // 3), 10 * cores}, asked


def test_ranks_without_a_count_take_the_sessions_shuffle_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.shuffle.partitions")
    try:
        assert ntile._parts(spark) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_attach_flags_are_dealt_by_the_number_of_lines(spark):
    products = [(1, "a", "rich", 100, 10, 0), (2, "b", "poor", 100, 95, 0)]
    orders = [order(i, i % 3, T(1998, 7, 2 + i)) for i in range(1, 9)]
    items = [(i, p, 1, 100, 100) for i in range(1, 9) for p in ((1, 2) if i % 4 == 0 else (2,))]
    star = star_from_rows(spark, product=products, orders=orders, items=items,
                          customer=[customer(i, T(1998, 7, 1)) for i in range(3)])
    whole = QUERIES["high_margin_attach"](star)
    star.pieces["items"] = 7
    dealt = QUERIES["high_margin_attach"](star)
    assert re.search(r"hashpartitioning\(order_id#\d+L, 7\), REPARTITION_BY_NUM", plan(dealt)), plan(dealt)
    rows = sorted(map(tuple, dealt.collect()))
    assert rows == sorted(map(tuple, whole.collect())) and [r[1:] for r in rows] == [(8, 25.0)], rows
