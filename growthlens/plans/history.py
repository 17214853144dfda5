"""Customer history as bit sets: the months in which a customer had an order delivered.

A row holds 64 calendar months of one customer as the bits of a bigint, so a customer with a third of all orders is a
few rows like any other.  Adding the orders of a month is an OR (``merged``): the orders of other months are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_index

WORD_BITS = 64


def _months_since_0(month: str | Column) -> Column:
    return month_index(month) - 1


def month_bits(orders: DataFrame) -> DataFrame:
    """customer_id, word and active_bits of delivered orders (customer_id, order_month); one map-side combined OR."""
    month = _months_since_0("order_month")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (month % WORD_BITS).cast("int"))
    return orders.groupBy("customer_id", F.expr(f"(year(order_month) * 12L + month(order_month) - 1) div {WORD_BITS}")
                          .alias("word")).agg(F.bit_or(bit).alias("active_bits"))


def merged(*histories: DataFrame) -> DataFrame:
    """One history out of several, of other months or of the same."""
    rows = histories[0]
    for more in histories[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("customer_id", "word").agg(F.bit_or("active_bits").alias("active_bits"))


def active_months(history: DataFrame) -> DataFrame:
    """customer_id and order_month, one row per customer and active month."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda k: F.getbit("active_bits", k) == 1)
    month = F.col("word") * WORD_BITS + F.col("place")
    year, of_year = F.expr(f"(word * {WORD_BITS} + place) div 12"), month % 12 + 1
    return history.select("customer_id", "word", F.explode(places).alias("place")).select(
        "customer_id", F.make_date(year.cast("int"), of_year.cast("int"), F.lit(1)).alias("order_month"))
