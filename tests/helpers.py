"""Small hand-made star tables for unit tests."""

from __future__ import annotations

import datetime as dt

from growthlens.config import FIXTURES
from growthlens.sources.star import SCHEMAS, Star

T = dt.datetime
D = dt.date


def star_from_rows(spark, params=FIXTURES, **rows) -> Star:
    """Build a Star from python tuples (column order of ``SCHEMAS``); missing tables are empty."""
    tabs = {}
    for key, schema in SCHEMAS.items():
        tabs[key] = spark.createDataFrame(rows.get(key, []), schema)
    return Star(params=params, **tabs)


def order(oid, cid, ts, status="delivered", promised=12, actual=10, item_total=1000, discount=0,
          rating=None, missing=0, store=1):
    fee = 25 if item_total < 100000 else 0
    return (oid, cid, store, ts, status, promised, None if status == "cancelled" else actual, item_total,
            discount, fee, 4, item_total - discount + fee + 4, "upi", rating, missing)


def customer(cid, signup, channel="organic", platform="android", home=1):
    return (cid, signup, channel, platform, home)


def stores(n=8):
    return [(i, f"ST-{i}", f"Z{i}", "C", D(1994, 1, 1), 10 + i % 5) for i in range(n)]
