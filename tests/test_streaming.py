"""Streaming session funnel == batch session funnel on the fixture events."""

import os

from pyspark.sql import functions as F

from growthlens.config import FIXTURES
from growthlens.plans.base import session_funnel
from growthlens.sources.star import SCHEMAS
from growthlens.sources.tpch_adapter import tpch_star
from growthlens.streaming.funnel_stream import funnel_monthly_from_sessions, start_session_sink

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, scratch):
    star = tpch_star(spark, SF, FIXTURES)
    ev = star.events
    # land the log as two files, split by time, so the stream sees two micro-batches
    lo, hi = ev.agg(F.min("event_ts"), F.max("event_ts")).first()
    mid = lo + (hi - lo) / 2
    src = os.path.join(scratch, "events")
    ev.filter(F.col("event_ts") < F.lit(mid)).coalesce(1).write.parquet(os.path.join(src, "part=1"))
    ev.filter(F.col("event_ts") >= F.lit(mid)).coalesce(1).write.parquet(os.path.join(src, "part=2"))
    stream = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, ckpt = os.path.join(scratch, "sessions"), os.path.join(scratch, "ckpt")
    q = start_session_sink(stream, FIXTURES, out, ckpt, watermark="0 seconds", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    # sessions still open at the end of the log are held in state (append mode):
    # compare everything that closed before the final watermark
    last = ev.agg(F.max("event_ts")).first()[0]
    batch = session_funnel(star).join(
        ev.groupBy("session_id").agg(F.max("event_ts").alias("last_event_ts")), "session_id")
    gap = FIXTURES.session_gap_seconds
    closed = batch.filter(F.col("last_event_ts") + F.expr(f"INTERVAL {gap + 1} SECONDS") <= F.lit(last))
    cols = ["customer_id", "session_start", "session_month", "platform", "used_search", "reached_pv",
            "reached_cart", "reached_checkout", "converted", "payment_ts"]
    a = sorted(map(repr, closed.select(*cols).collect()))
    b = sorted(map(repr, got.select(*cols).collect()))
    assert len(a) > 0
    assert a == b
    fm = funnel_monthly_from_sessions(got, star.customer)
    assert fm.agg(F.sum("sessions")).first()[0] == len(b)
