"""Idempotent reload by month of a written star and its feeds.

A delivery holds whole months of the facts, one or many, and the dimension tables.  Months whose rows differ from the
stored ones, as multisets, replace them (dynamic partition overwrite); the files of all other months stay untouched, so
the same delivery twice writes nothing the second time.  A month that the delivery has no row of stays as it is.

Months are compared by their row count and the sum of row hashes, one pruned aggregate over the stored months that the
delivery names; what reaches the driver is one row a table and month.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.feeds import FEEDS, feed_partition, write_feed
from .star import MONTH_KEYS, TABLE_NAMES, Star, table_path, with_months, write_counts, write_table

#: Feeds whose rows of a month depend on the orders and lines of that month and on dimensions only.
_OF_ORDER_MONTH = {"feed_fact_orders", "feed_order_month", "feed_store_month_ops"}
_DIMENSIONS = ("store", "product", "customer")


def _digests(df: DataFrame, month: str | None) -> dict:
    """{month: (rows, sum of row hashes)}; a table without months has the one key None."""
    columns = sorted(c for c in df.columns if c != month)
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash")
    key = F.lit(None).cast("date") if month is None else F.col(month).cast("date")
    return {r.month: (r.rows, r.hash) for r in
            df.groupBy(key.alias("month")).agg(F.count(F.lit(1)).alias("rows"), total).collect()}


def _in_months(column: str, months) -> Column:
    named = F.col(column).isin([m for m in months if m is not None])
    return named | F.col(column).isNull() if None in months else named


def _stored(df: DataFrame, path: str) -> DataFrame | None:
    """The table at ``path`` in the columns and types of ``df``; None where there is none yet."""
    try:
        old = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if set(old.columns) != set(df.columns):
        return None
    return old.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def _replace_changed(df: DataFrame, path: str, month: str | None, write) -> tuple[list, int]:
    """Months of ``df`` (None for a table without) that differ from those at ``path`` and were written, and by how many
    rows the table grew."""
    new, old = _digests(df, month), _stored(df, path)
    if old is None:
        write(df, "static")
        return list(new), sum(n for n, _ in new.values())
    before = _digests(old.where(_in_months(month, new)) if month else old, month)
    changed = [m for m, digest in new.items() if before.get(m) != digest]
    if month is None and not new and before:  # the table became empty
        changed = [None]
    if changed:
        write(df.where(_in_months(month, changed)) if month else df, "dynamic" if month else "static")
    return changed, sum(new.get(m, (0,))[0] - before.get(m, (0,))[0] for m in changed)


def reload_star(delivery: Star, path: str) -> dict[str, list[_dt.date | None]]:
    """Bring the star at ``path`` up to the delivery; the months written of each table (None: a whole table)."""
    spark, out, grown = delivery.spark, {}, {}
    for key, df in with_months(delivery).items():
        month = MONTH_KEYS[key][0] if key in MONTH_KEYS else None
        out[key], grown[key] = _replace_changed(
            df, table_path(path, key), month, lambda d, mode, key=key: write_table(key, d, path, mode))
    if any(out.values()):
        write_counts(spark, _counts(spark, path, grown), path)
    return {key: sorted(months, key=lambda m: m or _dt.date.min) for key, months in out.items()}


def _counts(spark, path: str, grown: dict[str, int]) -> dict[str, int]:
    from .star import _observed_counts

    known = _observed_counts(spark, path)
    before = {r.table_name: r.rows_loaded for r in known.collect()} if known is not None else {}
    return {key: before.get(TABLE_NAMES[key], 0) + n for key, n in grown.items()}


def reload_feeds(star: Star, path: str, changed: dict[str, list]) -> dict[str, list]:
    """Bring the feeds at ``path`` up to the reloaded ``star``, given what ``reload_star`` returned.

    Order feeds are built for the changed months alone unless a dimension changed; the others, which are small, are
    built whole, and only months that differ are written.
    """
    months = set(changed.get("orders", [])) | set(changed.get("items", [])) - {None}
    dimensions = any(changed.get(key) for key in _DIMENSIONS)
    out = {}
    for name, build in FEEDS.items():
        month, df = feed_partition(name), build(star)
        if name == "feed_fact_orders":
            df = df.withColumn(month, F.trunc("order_date", "month"))
        if name in _OF_ORDER_MONTH and not dimensions:
            if not months:
                out[name] = []
                continue
            df = df.where(_in_months(month, months))
        out[name], _ = _replace_changed(df, f"{path}/{name}", month,
                                        lambda d, mode, name=name: write_feed(name, d, f"{path}/{name}", mode))
    return out
