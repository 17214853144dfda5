"""Every business parameter in one frozen object.

Queries never hard-code a date or threshold; they read it from ``Params``.
``DEFAULTS`` holds the production defaults of the analytics suite (data window
Sep 2025 - Aug 2026).  ``FIXTURES`` is the profile for the driver's TPC-H style
test tables, whose customers order about once per eight months, so the day
thresholds are stretched (see FIXTURES.md section 4).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

D = _dt.date


@dataclass(frozen=True)
class Params:
    # fixed values: dates and thresholds of the metric definitions
    # --- time anchors -------------------------------------------------------
    as_of: D = D(2026, 8, 31)
    # last month whose activity is observable (retention censoring)
    observation_month: D = D(2026, 8, 1)
    promo_cohort: D = D(2026, 5, 1)
    stress_start: D = D(2026, 5, 1)
    scorecard_first_month: D = D(2025, 9, 1)
    scorecard_last_month: D = D(2026, 8, 1)
    # --- order economics ----------------------------------------------------
    late_tolerance_min: int = 5
    last_mile_cost: int = 30
    # --- activation / lifecycle ---------------------------------------------
    activation_days: int = 7
    active_days: int = 28
    churn_days: int = 56
    min_history_days: int = 90
    repeat_window_days: int = 28
    reorder_window_days: int = 30
    scorecard_days: int = 90
    payback_max_tenure: int = 6
    discount_led_share_pct: int = 50
    retention_offsets: int = 12
    # --- health scores ------------------------------------------------------
    health_window_days: int = 56
    health_trend_days: int = 28
    health_experience_days: int = 90
    product_window_days: int = 56
    product_max_weeks: int = 8
    # fixed values: score bands of the customer health score
    recency_bands: tuple = ((7, 30), (14, 24), (28, 18), (42, 10), (56, 5))
    orders_bands: tuple = ((8, 25), (5, 20), (3, 15), (2, 10), (1, 5))
    spend_bands: tuple = ((4000, 20), (2500, 16), (1500, 12), (750, 8))
    spend_floor_points: int = 4
    perfect_bands_pct: tuple = ((90, 15), (75, 12), (60, 8), (40, 4))
    # --- stores -------------------------------------------------------------
    stressed_stores: tuple = (4, 6)
    # --- audit --------------------------------------------------------------
    audit_orders_range: tuple = (120_000, 260_000)
    audit_customers_range: tuple = (18_000, 32_000)
    audit_min_events: int = 1_000_000
    audit_window: tuple = (D(2025, 9, 1), D(2026, 9, 1))
    # --- engine -------------------------------------------------------------
    # Events are sessionised inside time buckets of this width so that one
    # very active user never lands in a single sort task.
    session_gap_seconds: int = 12 * 3600
    session_bucket_seconds: int = 3600
    # a (user, bucket) with more events than this is cut into minute buckets
    session_hot_bucket_rows: int = 1_000_000
    session_fine_seconds: int = 60
    # A join key with more rows than this on the row-level side is "hot": its
    # per-key row is broadcast to those rows instead of shuffling them to one
    # task.  At most (rows / hot_key_rows) keys can be hot, which bounds the
    # broadcast.
    hot_key_rows: int = 2_000_000

    # derived dates -----------------------------------------------------------
    def days_before_as_of(self, n: int) -> D:
        return self.as_of - _dt.timedelta(days=n)

    @property
    def last_full_m1_cohort(self) -> D:
        """The last cohort whose month 1 is observable: the month before the observation month."""
        last = self.observation_month.replace(day=1) - _dt.timedelta(days=1)
        return last.replace(day=1)

    @property
    def as_of_end(self) -> D:
        """Exclusive upper bound of the data window (as-of day included)."""
        return self.as_of + _dt.timedelta(days=1)

    @property
    def churn_signup_cutoff(self) -> D:
        return self.days_before_as_of(self.min_history_days)

    @property
    def reorder_cutoff(self) -> D:
        """Rated orders up to this midnight have a full reorder window."""
        return self.days_before_as_of(self.reorder_window_days + 1)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULTS = Params()

# The parameter profile for the driver's test tables (FIXTURES.md section 4).
FIXTURES = Params(
    as_of=D(2001, 8, 1),
    observation_month=D(2001, 8, 1),
    promo_cohort=D(1995, 5, 1),
    stress_start=D(2000, 1, 1),
    scorecard_first_month=D(1994, 11, 1),
    scorecard_last_month=D(2001, 8, 1),
    active_days=120,
    churn_days=240,
    min_history_days=365,
    repeat_window_days=240,
    reorder_window_days=240,
    health_window_days=480,
    health_trend_days=240,
    health_experience_days=720,
    product_window_days=480,
    spend_bands=((800_000, 20), (500_000, 16), (300_000, 12), (150_000, 8)),
    audit_orders_range=(1, 1_000_000_000),
    audit_customers_range=(1, 1_000_000_000),
    audit_min_events=1,
    audit_window=(D(1994, 11, 1), D(2001, 9, 1)),
)
