"""Incremental session funnel with Structured Streaming.

The app-event log is the natural stream.  Sessions are closed by event-time
inactivity: ``session_window(event_ts, gap)`` groups a customer's events that
are at most ``gap`` apart, the watermark bounds how late an event may arrive,
and in append mode each session is emitted once, after the watermark has
passed its end, then dropped from state.  The rows have the batch
``session_funnel`` shape (reach flags, payment time) keyed by
(customer_id, session_start) and feed the monthly funnel aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Params
from ..functions.dates import epoch_second, month_start
from ..plans.base import flag


def session_funnel_stream(events: DataFrame, params: Params, watermark: str = "2 hours") -> DataFrame:
    """Streaming (or batch) events -> one row per closed session.

    A new session starts when an event comes more than ``session_gap_seconds``
    after the previous one (Spark's session window merges events closer than
    the gap, so the window gap is one second more for whole-second times).
    """
    name = F.col("event_name")
    gap = f"{params.session_gap_seconds + 1} seconds"

    def reached(n):
        return F.max(flag(name == n))

    # watermarks need TIMESTAMP (an instant); build it from epoch seconds so no
    # session time zone (and no DST gap) is involved
    timed = events.withColumn("_t", F.timestamp_seconds(epoch_second("event_ts")))
    return (timed.withWatermark("_t", watermark)
            .groupBy("customer_id", F.session_window("_t", gap).alias("session"))
            .agg(F.min("event_ts").alias("session_start"),
                 F.max("event_ts").alias("last_event_ts"),
                 F.max("platform").alias("platform"),
                 reached("search").alias("used_search"),
                 reached("product_view").alias("reached_pv"),
                 reached("add_to_cart").alias("reached_cart"),
                 reached("checkout_start").alias("reached_checkout"),
                 reached("payment_success").alias("converted"),
                 F.max(F.when(name == "payment_success", F.col("event_ts"))).alias("payment_ts"))
            .select("customer_id", "session_start", "last_event_ts",
                    month_start("session_start").alias("session_month"), "platform", "used_search",
                    "reached_pv", "reached_cart", "reached_checkout", "converted", "payment_ts"))


def start_session_sink(events: DataFrame, params: Params, out_path: str, checkpoint_location: str,
                       watermark: str = "2 hours", available_now: bool = False) -> StreamingQuery:
    """Append closed sessions to a parquet table (exactly-once file sink).

    ``checkpoint_location`` must be on shared storage so a restarted driver
    resumes from the last committed offsets and state.
    """
    w = (session_funnel_stream(events, params, watermark).writeStream
         .format("parquet").option("path", out_path).option("checkpointLocation", checkpoint_location)
         .partitionBy("session_month").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def funnel_monthly_from_sessions(sessions: DataFrame, customers: DataFrame) -> DataFrame:
    """``feed_funnel_monthly`` from streamed session rows (month x platform x channel)."""
    from ..operators.feeds import funnel_monthly

    return funnel_monthly(sessions, customers)
