"""The written feeds, as a source of measures: nothing here reads a fact of the star."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..plans.base import item_margin_by_order
from ..plans.ntile import ensure_checkpoint_dir
from ..sources.star import Star
from .feeds import grid_of_cohorts, write_feeds

_DATES = ("month", "session_month", "month_start", "order_month")


@dataclass
class Feeds:
    """Reads the feeds of ``write_feeds`` under ``path`` when a measure asks for them."""

    spark: SparkSession
    path: str
    params: Params = DEFAULTS
    _frames: dict = field(default_factory=dict, repr=False)

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            df = self.spark.read.parquet(f"{self.path}/{name}")
            self._frames[name] = df.withColumns({c: F.col(c).cast("date") for c in _DATES if c in df.columns
                                                 and dict(df.dtypes)[c] != "date" and name != "feed_dim_date"})
        return self._frames[name]

    def cohorts(self) -> DataFrame:
        return grid_of_cohorts(self.frame("feed_dim_customer"), self.frame("feed_cohort_retention"), self.params)


def with_history(star: Star, feeds: Feeds) -> Star:
    """The star with the kept history of its customers, so that retention reads that in place of the orders."""
    return replace(star, history=feeds.frame("feed_customer_months"), _cache={})


#: Feeds that read orders, and those that read the margins of their lines too.
_WITH_MARGIN = {"feed_order_month", "feed_fact_orders"}
_WITH_ORDERS = _WITH_MARGIN | {"feed_dim_customer", "feed_marketing", "feed_cohort_retention", "feed_customer_months",
                               "feed_store_month_ops"}


def with_orders_kept(star: Star, path: str, names: list[str]) -> Star:
    """The star with its orders, its customers and the margins of its orders written under ``path`` and read from there.

    A star derived from other tables sums its order lines for each feed that reads orders: here they are summed once.
    """
    if len(_WITH_ORDERS.intersection(names)) < 2:
        return star

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/star/{name}")
        return star.spark.read.schema(df.schema).parquet(f"{path}/star/{name}")

    out = replace(star, orders=kept("orders", star.orders), customer=kept("customer", star.customer), _cache={})
    if _WITH_MARGIN.intersection(names):
        margins = kept("item_margin", item_margin_by_order(star))
        out.memo("item_margin_by_order", lambda: margins)
    return out


def persisted_feeds(star: Star, *names: str) -> Feeds:
    """The named feeds of ``star``, written to the shared checkpoint folder and opened from there."""
    def build():
        path = f"{ensure_checkpoint_dir(star.spark)}/feeds-{uuid.uuid4().hex}"
        write_feeds(with_orders_kept(star, path, list(names)), path, list(names))
        return Feeds(star.spark, path, star.params)
    return star.memo(f"persisted feeds {sorted(names)}", build)
