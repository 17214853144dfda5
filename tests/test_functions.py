"""Column helpers: exact rounding (T1), boundary-counting dates (T3-T5)."""

import datetime as dt
from fractions import Fraction

from pyspark.sql import functions as F

from growthlens.functions.dates import (days_between, epoch_second, from_epoch_second, hours_between_boundaries,
                                        months_between_boundaries)
from growthlens.functions.ratios import pct, round_ratio


def _half_away(fr: Fraction, scale: int) -> float:
    q = abs(fr) * 10**scale
    n = int(q + Fraction(1, 2))
    return (n if fr >= 0 else -n) / 10**scale


def test_round_ratio_matches_half_away_from_zero(spark):
    cases = [(1, 8), (3, 8), (5, 16), (1, 40), (-1, 8), (-3, 8), (-5, 16), (-1, 40), (2, 3), (0, 7), (7, 0)]
    df = spark.createDataFrame(cases, "n long, d long")
    got = df.select("n", "d", *[round_ratio("n", "d", s).alias(f"s{s}") for s in (0, 1, 2, 3)],
                    pct("n", "d").alias("p")).collect()
    for r in got:
        if r.d == 0:
            assert r.s0 is None and r.p is None
            continue
        fr = Fraction(r.n, r.d)
        for s in (0, 1, 2, 3):
            assert r[f"s{s}"] == _half_away(fr, s), (r, s)
        assert r.p == _half_away(fr * 100, 1)


def test_month_hour_day_boundaries(spark):
    T = dt.datetime
    rows = [
        (T(2026, 1, 31, 23, 0), T(2026, 2, 1, 1, 0)),   # one month boundary, 2 hours, 1 day
        (T(2025, 12, 31, 10, 59), T(2026, 1, 1, 11, 1)),  # year end
        (T(2026, 3, 1, 10, 59), T(2026, 3, 1, 11, 1)),   # same day, one hour boundary
        (T(2026, 3, 1, 0, 0), T(2026, 3, 8, 0, 0)),      # exactly 7 days
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = df.select(months_between_boundaries("a", "b").alias("m"), hours_between_boundaries("a", "b").alias("h"),
                    days_between("a", "b").alias("d")).collect()
    assert [(r.m, r.h, r.d) for r in got] == [(1, 2, 1), (1, 25, 1), (0, 1, 0), (0, 168, 7)]


def test_epoch_seconds_roundtrip_ignores_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        ts = dt.datetime(2001, 7, 1, 0, 9, 58)
        df = spark.createDataFrame([(ts,)], "t timestamp_ntz")
        r = df.select(epoch_second("t").alias("s"), from_epoch_second(epoch_second("t")).alias("back")).first()
        assert r.s == int((ts - dt.datetime(1970, 1, 1)).total_seconds())
        assert r.back == ts
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
