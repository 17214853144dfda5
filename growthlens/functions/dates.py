"""Boundary-counting date arithmetic as Column expressions.

All helpers work on TIMESTAMP_NTZ / DATE columns and never consult the
session time zone, so results do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_DAY = _dt.date(1970, 1, 1)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_day(ts) -> Column:
    """Days since 1970-01-01 of the calendar day of ``ts``."""
    return F.datediff(_c(ts).cast("date"), F.lit(_EPOCH_DAY)).cast("long")


def epoch_hour(ts) -> Column:
    """Whole hours since the epoch of the hour that contains ``ts``."""
    ts = _c(ts)
    return epoch_day(ts) * 24 + F.hour(ts)


def epoch_second(ts) -> Column:
    """Whole seconds since the epoch (fractions of a second dropped)."""
    ts = _c(ts)
    return epoch_hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_epoch_second(sec) -> Column:
    """TIMESTAMP_NTZ for a count of seconds since the epoch."""
    return F.timestamp_add("SECOND", _c(sec), ts_lit(_dt.date(1970, 1, 1)))


def month_start(ts) -> Column:
    """First day of the month as DATE."""
    return F.trunc(_c(ts).cast("date"), "month")


def month_index(d) -> Column:
    d = _c(d)
    return (F.year(d) * 12 + F.month(d)).cast("long")


def months_between_boundaries(start, end) -> Column:
    """Number of month boundaries crossed from ``start`` to ``end`` (T3)."""
    return month_index(end) - month_index(start)


def hours_between_boundaries(start, end) -> Column:
    """Number of hour boundaries crossed from ``start`` to ``end`` (T4)."""
    return epoch_hour(end) - epoch_hour(start)


def days_between(start, end) -> Column:
    """Number of midnights crossed from ``start`` to ``end`` (T5)."""
    return F.datediff(_c(end).cast("date"), _c(start).cast("date")).cast("long")


def seconds_between(start, end) -> Column:
    return epoch_second(end) - epoch_second(start)


def date_lit(d: _dt.date) -> Column:
    return F.lit(d)


def ts_lit(d: _dt.date | _dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal (midnight for a date); built from text so no
    session time zone is involved."""
    if not isinstance(d, _dt.datetime):
        d = _dt.datetime(d.year, d.month, d.day)
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def add_months(d, n: int) -> Column:
    return F.add_months(_c(d), n)
