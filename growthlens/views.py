"""The datasets as SQL views.

``sql(star, text)`` answers a statement over any registered dataset by its name, and over the loaded tables by theirs
(``fact_orders``, ``dim_customer``, ...).  Parameters of the datasets are named: ``sql(star, text, as_of=...)``.  Only
the datasets that the statement names are built, each with what it depends on, and they are views of plans: filters
and column choices of the statement reach their scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .catalog import QUERIES
from .sources.star import TABLE_NAMES, Star


def datasets() -> list[str]:
    """Every name that a statement may use; a dataset goes before a loaded table of the same name."""
    return [*QUERIES, *[t for t in TABLE_NAMES.values() if t not in QUERIES]]


def with_params(star: Star, **params) -> Star:
    """The star under other parameters; what was built under the old ones is not kept."""
    unknown = [p for p in params if not hasattr(star.params, p)]
    if unknown:
        raise KeyError(f"unknown parameters {unknown}")
    return Star(**star.tables(), params=star.params.with_(**params), by_month=star.by_month, loaded=star.loaded,
                pieces=star.pieces)


def register(star: Star, names: list[str], prefix: str = "") -> list[str]:
    """Temporary views of the named datasets and tables; returns the views' names."""
    tables = {TABLE_NAMES[key]: df for key, df in star.tables().items()}
    for name in names:
        df = QUERIES[name](star) if name in QUERIES else tables[name]
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in names]


def sql(star: Star, text: str, args: dict | None = None, **params) -> DataFrame:
    """The result of a statement; ``args`` are its own parameter markers, ``params`` those of the datasets."""
    star = with_params(star, **params) if params else star
    words = set(re.findall(r"\w+", text))
    register(star, [name for name in datasets() if name in words])
    return star.spark.sql(text, args=args or {})
