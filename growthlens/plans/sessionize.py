"""Inactivity-gap sessionisation that survives one user owning a third of the log.

The textbook plan (``lag`` + running sum over ``partitionBy(user)``) sorts all
events of a user in one task.  Here the sort is bounded by a time bucket:

1. window over (user, bucket): previous event time and running count of the
   session starts that can be decided locally (every event but the first of
   its bucket);
2. aggregate per (user, bucket): first/last time and number of local starts
   (no new shuffle, the data is already clustered that way);
3. a window over the *bucket summaries* of a user (at most one row per
   non-empty bucket) decides whether each bucket's first event starts a
   session and prefix-sums the starts of earlier buckets;
4. one join back on (user, bucket).

The session ordinal of an event is then ``starts before its bucket`` +
``starts up to it inside its bucket``; identical to the global plan.

Buckets only have to be contiguous time intervals numbered in time order.  With
``hot_rows`` set, a (user, bucket) holding more events than that (found with a
map-side-combined count; the MAX_HOT_CELLS heaviest of them, so the list can be
broadcast) is cut into ``fine_seconds`` buckets instead, numbered so that the
order across a user's buckets still follows time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import idiv


#: The heaviest cells only, so that the broadcast list stays short however much data there is.
MAX_HOT_CELLS = 10_000


def _buckets(events: DataFrame, user: str, t: str, bucket_seconds: int,
             hot_rows: int | None, fine_seconds: int) -> DataFrame:
    coarse = idiv(F.col(t), F.lit(bucket_seconds))
    if hot_rows is None:
        return events.withColumn("_bk", coarse)
    if bucket_seconds % fine_seconds:
        raise ValueError("bucket_seconds must be a multiple of fine_seconds")
    per = bucket_seconds // fine_seconds
    ev = events.withColumn("_cb", coarse)
    hot = (ev.groupBy(user, "_cb").agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > hot_rows).orderBy(F.desc("_n"), user, "_cb").limit(MAX_HOT_CELLS)
             .select(user, "_cb", F.lit(1).alias("_hot")))
    fine = idiv(F.col(t), F.lit(fine_seconds))  # lies in [_cb * per, _cb * per + per)
    return (ev.join(F.broadcast(hot), [user, "_cb"], "left")
              .withColumn("_bk", F.when(F.col("_hot").isNotNull(), fine).otherwise(F.col("_cb") * per))
              .drop("_cb", "_hot"))


def sessionize(events: DataFrame, user: str, t: str, tie: str,
               gap_seconds: int, bucket_seconds: int,
               hot_rows: int | None = None, fine_seconds: int = 60, pieces: int | None = None) -> DataFrame:
    """Add ``session_idx`` (1-based per user) and ``is_session_start`` (0/1).

    ``t`` is an integer time in seconds, ``tie`` breaks equal times.  A new
    session starts at a user's first event and whenever the time since the
    previous event (in (t, tie) order) exceeds ``gap_seconds``.  ``pieces`` says how many tasks share the windows; without
    it adaptive execution merges them by their shuffled bytes.
    """
    ev = _buckets(events, user, t, bucket_seconds, hot_rows, fine_seconds)
    if pieces:
        ev = ev.repartition(pieces, user, "_bk")
    w_local = Window.partitionBy(user, "_bk").orderBy(t, tie)
    prev = F.lag(t).over(w_local)
    ev = (ev.withColumn("_prev", prev)
            .withColumn("_lstart", F.when(F.col("_prev").isNotNull() & (F.col(t) - F.col("_prev") > gap_seconds), 1)
                        .otherwise(0))
            .withColumn("_lrun", F.sum("_lstart").over(w_local.rowsBetween(Window.unboundedPreceding, 0))))

    w_b = Window.partitionBy(user).orderBy("_bk")
    buckets = (ev.groupBy(user, "_bk")
                 .agg(F.min(t).alias("_bmin"), F.max(t).alias("_bmax"), F.sum("_lstart").alias("_nl")))
    prev_max = F.lag("_bmax").over(w_b)
    buckets = (buckets
               .withColumn("_fstart", F.when(prev_max.isNull() | (F.col("_bmin") - prev_max > gap_seconds), 1)
                           .otherwise(0))
               .withColumn("_bstarts", F.col("_fstart") + F.col("_nl"))
               .withColumn("_before", F.sum("_bstarts").over(w_b.rowsBetween(Window.unboundedPreceding, 0))
                           - F.col("_bstarts"))
               .select(user, "_bk", "_fstart", "_before"))

    # summaries are nearly as many as the events, whatever size the planner expects: both sides are dealt out, none broadcast
    out = ev.join(buckets.hint("merge"), [user, "_bk"])
    is_first_in_bucket = F.col("_prev").isNull()
    return (out
            .withColumn("session_idx", F.col("_before") + F.col("_fstart") + F.col("_lrun"))
            .withColumn("is_session_start",
                        F.when(is_first_in_bucket, F.col("_fstart")).otherwise(F.col("_lstart")).cast("int"))
            .drop("_bk", "_prev", "_lstart", "_lrun", "_fstart", "_before"))
