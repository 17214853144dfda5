"""``dim_date``: one row per calendar day, Monday = 0 regardless of locale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_date(days: list[tuple[DataFrame, str]]) -> DataFrame:
    """Calendar over the (table, date or time column) pairs ``days``: whole months, from the month before the first
    day of any table to the month after the last one (none where no table has a day).

    The span is one aggregated row a table; its days are one ``sequence`` exploded.
    """
    d = F.col("date_key")
    dow = F.weekday(d)  # 0 = Monday
    ends = reduce(DataFrame.unionByName, [
        df.agg(F.min(c).cast("date").alias("first"), F.max(c).cast("date").alias("last")) for df, c in days])
    span = ends.agg(F.trunc(F.add_months(F.min("first"), -1), "month").alias("first"),
                    F.last_day(F.add_months(F.max("last"), 1)).alias("last"))
    return (
        span.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("date_key"))
        .select(
            d,
            F.year(d).alias("year"),
            F.month(d).alias("month"),
            F.trunc(d, "month").alias("month_start"),
            F.date_format(d, "MMMM").alias("month_name"),
            F.date_format(d, "yyyy-MM").alias("year_month"),
            F.dayofmonth(d).alias("day"),
            dow.alias("day_of_week"),
            F.date_format(d, "EEEE").alias("day_name"),
            F.when(dow >= 5, 1).otherwise(0).alias("is_weekend"),
            F.date_sub(d, dow).alias("week_start"),
        )
    )
