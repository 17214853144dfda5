"""Exact output rounding.

The reported numbers are ratios of integers rounded half away from zero to a
fixed number of decimals.  Doing that in floating point makes results depend
on the engine; instead the rounding is done in integer arithmetic
(DECIMAL(38,0) so 100 TB sums cannot overflow) and only the final,
already-rounded value becomes a DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded_units(num, den, scale: int = 1, mult: int = 1) -> Column:
    """round_half_away(mult * num / den * 10**scale) as LONG (NULL when den is 0)."""
    n = _c(num).cast(DEC)
    d = F.nullif(_c(den).cast(DEC), F.lit(0).cast(DEC))
    k = F.lit(2 * (10**scale) * mult).cast(DEC)
    q = F.call_function("div", F.abs(n) * k + d, d * F.lit(2).cast(DEC))
    return F.when(n < 0, -q).otherwise(q)


def round_ratio(num, den, scale: int = 1, mult: int = 1) -> Column:
    """round_half_away(mult * num / den, scale) as DOUBLE.

    NULL when ``den`` is 0 or NULL (NULLIF semantics); ``den`` must be > 0.
    """
    return rounded_units(num, den, scale, mult).cast("double") / F.lit(float(10**scale))


def idiv(num, den) -> Column:
    """Integer division truncating toward zero (SQL ``div``); NULL on 0."""
    return F.call_function("div", _c(num), F.nullif(_c(den), F.lit(0)))


def pct(num, den, scale: int = 1) -> Column:
    """Percentage ``100 * num / den`` rounded to ``scale`` decimals."""
    return round_ratio(num, den, scale, 100)


def exact_round(x, scale: int = 0) -> Column:
    """An integer-valued column scaled down by ``10**scale`` as DOUBLE."""
    return _c(x).cast("double") / F.lit(float(10**scale))
