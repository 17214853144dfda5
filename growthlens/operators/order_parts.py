"""The parts of the order measures: what each sums over order rows, and how partial sums merge.

Everything but the number of active customers adds up.  That one is a 0/1 flag a customer inside a slice, a bitmap of
customers in the persisted feed, and a count of either only at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.star import month_ranged


def delivered() -> Column:
    return F.col("status") == "delivered"


def _sum_if(col: str):
    return lambda: F.sum(F.when(delivered(), F.col(col)))


ORDER_PARTS = {
    "_do": lambda: F.count(F.when(delivered(), 1)),
    "_gmv": _sum_if("item_total"),
    "_net": _sum_if("net_amount"),
    "_disc": _sum_if("discount_amount"),
    "_act": lambda: F.countDistinct(F.when(delivered(), F.col("customer_id"))),
    "_contrib": _sum_if("contribution_rs"),
    "_margin": _sum_if("item_margin"),
    "_ontime": _sum_if("is_on_time"),
    "_perfect": _sum_if("is_perfect_order"),
    "_late": _sum_if("is_late_5plus"),
    "_dmin": _sum_if("actual_delivery_min"),
    "_dminn": lambda: F.count(F.when(delivered(), F.col("actual_delivery_min"))),
    "_canc": lambda: F.count(F.when(F.col("status") == "cancelled", 1)),
    "_all": lambda: F.count(F.lit(1)),
    "_rsum": _sum_if("rating"),
    "_rn": lambda: F.count(F.when(delivered(), F.col("rating"))),
    "_miss": _sum_if("items_missing"),
}
#: Parts that are zero, not NULL, where there is no row.
COUNTS = {"_do", "_act", "_dminn", "_canc", "_all", "_rn"}


def partial(alias: str) -> Column:
    """The part over the orders of one customer and slice."""
    return F.max(F.when(delivered(), 1).otherwise(0)) if alias == "_act" else ORDER_PARTS[alias]()


def merged(alias: str, col: str | None = None) -> Column:
    """The part over rows of partial ones, each of another customer or slice."""
    total = F.sum(col or alias)
    return F.coalesce(total, F.lit(0).cast("long")) if alias in COUNTS else total


# ---- the persisted feed ------------------------------------------------------------------------------------------

FEED_KEYS = ["month", "store_id", "acquisition_channel", "platform"]
_BUCKET, _ACTIVE = "customer_bucket", "active_bitmap"


def column_of(alias: str) -> str:
    """The name of a part's column in the feed."""
    return alias.lstrip("_") + "_part"


def month_feed(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Order parts by FEED_KEYS and bucket of customers, with the bitmap of the customers who had an order delivered.

    ``orders`` are fact rows with month, ``customers`` have customer_id, acquisition_channel and platform.  A bucket
    holds 32,768 neighbouring ids, so a bitmap has 4 KB however many orders a customer has.  Orders are summed a
    (customer, month, store) before the join with the customers, so no customer is a hot key.  Those narrow rows, not
    bitmaps, are dealt out: by ranges of month and bucket, as the feed is written.  A cell holds a bucket's customers by
    store, however many orders there are.
    """
    parts = list(ORDER_PARTS)
    per = orders.groupBy("customer_id", "month", "store_id").agg(*[partial(a).alias(a) for a in parts])
    active = F.when(F.col("_act") == 1, F.col("customer_id"))
    sums = [merged(a).alias(column_of(a)) for a in parts if a != "_act"]
    rows = per.join(customers, "customer_id", "left").withColumn(_BUCKET, F.bitmap_bucket_number("customer_id"))
    return (month_ranged(rows, "month", _BUCKET).groupBy(*FEED_KEYS, _BUCKET)
            .agg(*sums, F.bitmap_construct_agg(F.bitmap_bit_position(active)).alias(_ACTIVE)))


def sums_of_feed(feed: DataFrame, parts: list[str], by: list[str], levels: list[tuple[str, ...]] | None) -> DataFrame:
    """The parts as ``m_`` + alias for every slice of the feed; with ``levels``, for every grouping set and its ``gid``.

    Customers are merged by OR inside a bucket, and the bits counted after that, so a customer counts once in every
    slice, whatever months, stores and channels it unites.
    """
    sums = [merged(a, column_of(a)).alias("m_" + a) for a in parts if a != "_act"]
    if "_act" not in parts:
        return grouped(feed, by, levels).agg(*sums, *gid(by, levels))
    per_bucket = grouped(feed, by, levels, _BUCKET).agg(
        *sums, F.bitmap_count(F.bitmap_or_agg(_ACTIVE)).alias("m__act"), *gid(by, levels))
    return per_bucket.groupBy(*by, *GID[:bool(levels)]).agg(*[merged(a, "m_" + a).alias("m_" + a) for a in parts])


def with_counts(feed: DataFrame) -> DataFrame:
    """The feed by FEED_KEYS, with the number of active customers in place of the bitmaps."""
    sums = sums_of_feed(feed, list(ORDER_PARTS), FEED_KEYS, None)
    return sums.select(*FEED_KEYS, *[F.col("m_" + a).alias(column_of(a)) for a in ORDER_PARTS])


# ---- grouping sets -----------------------------------------------------------------------------------------------

def grouped(df: DataFrame, by: list[str], levels: list[tuple[str, ...]] | None, *always: str):
    """``groupBy(by)``, or the grouping sets ``levels`` of it; the columns ``always`` are in every set."""
    if levels is None:
        return df.groupBy(*by, *always)
    return df.groupingSets([[*level, *always] for level in levels], *by, *always)


#: Names the grouping set of a row: bit k is set where the k-th column of ``by`` is totalled.
GID = ["gid"]


def gid(by: list[str], levels) -> list[Column]:
    if not levels:
        return []
    bits = [F.grouping(c).cast("int") * (1 << k) for k, c in enumerate(by)]
    return [reduce(Column.__add__, bits, F.lit(0)).alias("gid")]
