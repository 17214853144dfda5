"""The star schema: typed table definitions, ``read_star`` and ``load_row_counts``.

Every integer column is a 64-bit LONG (ids, counts, whole-currency money);
flags are INT 0/1; timestamps are TIMESTAMP_NTZ (second precision, no zone).
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Params

L, I, S, DT, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


# Column order of each input file (header row expected).
SCHEMAS: dict[str, T.StructType] = {
    "store": _schema(
        ("store_id", L, False), ("store_code", S, False), ("zone_name", S, False),
        ("city", S, False), ("launch_date", DT, False), ("base_promise_min", L, False)),
    "product": _schema(
        ("product_id", L, False), ("product_name", S, False), ("category", S, False),
        ("unit_price", L, False), ("unit_cost", L, False), ("is_private_label", I, False)),
    "customer": _schema(
        ("customer_id", L, False), ("signup_ts", TS, False), ("acquisition_channel", S, False),
        ("platform", S, False), ("home_store_id", L, False)),
    "orders": _schema(
        ("order_id", L, False), ("customer_id", L, False), ("store_id", L, False),
        ("order_ts", TS, False), ("status", S, False), ("promised_min", L, False),
        ("actual_delivery_min", L, True), ("item_total", L, False), ("discount_amount", L, False),
        ("delivery_fee", L, False), ("handling_fee", L, False), ("net_amount", L, False),
        ("payment_method", S, False), ("rating", L, True), ("items_missing", I, False)),
    "items": _schema(
        ("order_id", L, False), ("product_id", L, False), ("quantity", L, False),
        ("unit_price", L, False), ("line_amount", L, False)),
    "events": _schema(
        ("session_id", L, False), ("customer_id", L, False), ("event_name", S, False),
        ("event_ts", TS, False), ("platform", S, False), ("order_id", L, True)),
    "spend": _schema(
        ("month_start", DT, False), ("channel", S, False), ("spend_inr", L, False)),
}

# File names of the original CSV export, one per star table.
FILE_NAMES = {
    "store": "stores.csv", "product": "products.csv", "customer": "customers.csv",
    "orders": "orders.csv", "items": "order_items.csv", "events": "app_events.csv",
    "spend": "marketing_spend.csv",
}

# The facts that ``write_star`` partitions by month: partition column, and the id that orders rows within a month.
MONTH_KEYS = {"orders": ("order_month", "order_id"), "items": ("order_month", "order_id"),
              "events": ("event_month", "session_id")}

# Names reported by ``load_row_counts`` (the physical table names).
TABLE_NAMES = {
    "store": "dim_store", "product": "dim_product", "customer": "dim_customer",
    "orders": "fact_orders", "items": "fact_order_items", "events": "fact_app_events",
    "spend": "fact_marketing_spend",
}

# Written beside the tables by ``write_star``.
COUNTS_TABLE = "load_row_counts"
_COUNTS = _schema(("table_name", S, False), ("rows_loaded", L, False))


@dataclass
class Star:
    """The seven loaded tables plus the parameters every query reads."""

    store: DataFrame
    product: DataFrame
    customer: DataFrame
    orders: DataFrame
    items: DataFrame
    events: DataFrame
    spend: DataFrame
    params: Params = DEFAULTS
    # items and events with their storage month, where they were read from month-partitioned files
    by_month: dict = field(default_factory=dict, repr=False)
    # (table_name, rows_loaded) as observed by the load, where the star was read from a written one
    loaded: DataFrame | None = field(default=None, repr=False)
    # months with an order per customer as bit sets (``plans.history``), where they are kept: retention reads them alone
    history: DataFrame | None = field(default=None, repr=False)
    # into how many pieces shuffles of a table's rows are dealt (``plans.skew.pieces``), where they were counted
    pieces: dict[str, int] = field(default_factory=dict, repr=False)
    _cache: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in SCHEMAS}

    def dealt(self, table: str, df: DataFrame, *keys: str) -> DataFrame:
        """``df``, rows of ``table``, hashed by ``keys`` into its pieces; left as it is where they were not counted."""
        return df.repartition(self.pieces[table], *keys) if table in self.pieces else df

    def memo(self, key: str, build):
        """Build a derived view once per Star (same DataFrame reused in plans)."""
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]


def read_star(spark: SparkSession, path: str, fmt: str = "csv", params: Params = DEFAULTS) -> Star:
    """Read the seven star tables.

    ``fmt='csv'``: header files as exported by the original loader (UTF-8, ``,``,
    empty field = NULL), read with an explicit schema and FAILFAST so a malformed
    row stops the load instead of silently becoming NULL.
    ``fmt='parquet'``: one directory per table named like the CSV file stem.
    """
    out, by_month = {}, {}
    for key, schema in SCHEMAS.items():
        stem = FILE_NAMES[key]
        if fmt == "csv":
            df = (spark.read.schema(schema)
                  .option("header", True).option("nullValue", "").option("mode", "FAILFAST")
                  .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
                  .option("dateFormat", "yyyy-MM-dd")
                  .csv(f"{path}/{stem}"))
        else:
            df = _read_parquet(spark, table_path(path, key), schema)
            cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
            if key == "orders":
                # keep the directory partition column where there is one: predicates on it prune whole months
                stored = "order_month" if "order_month" in df.columns else F.trunc(F.col("order_ts").cast("date"), "month")
                cols.append((F.col(stored) if isinstance(stored, str) else stored).cast("date").alias("order_month"))
            if key in MONTH_KEYS and key != "orders" and MONTH_KEYS[key][0] in df.columns:
                by_month[key] = df.select(*cols, F.col(MONTH_KEYS[key][0]).cast("date"))
            df = df.select(cols)
        out[key] = df
    loaded = _observed_counts(spark, path) if fmt == "parquet" else None
    return Star(params=params, by_month=by_month, loaded=loaded, **out)


def _read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a table without rows has no files by month
            return spark.createDataFrame([], schema)
        raise


def _observed_counts(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COUNTS).parquet(f"{path}/{COUNTS_TABLE}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # written by something else
            return None
        raise


def month_ranged(df: DataFrame, month: str, key: str) -> DataFrame:
    """Range-partition on (month, key) before a month-partitioned write: every
    task writes a contiguous run of months (few files per month directory) and
    a very large month is split over several tasks instead of one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return df.repartitionByRange(parts, month, key)


def with_months(star: Star) -> dict[str, DataFrame]:
    """The tables of the star; facts of MONTH_KEYS with the month they are stored under.

    A line lies in its order's month (the greatest one, if the order id occurs in several), a line without an order in
    the NULL partition.
    """
    tables = dict(star.tables())
    for key, ts in (("orders", "order_ts"), ("events", "event_ts")):
        tables[key] = tables[key].withColumn(MONTH_KEYS[key][0], F.trunc(F.col(ts).cast("date"), "month"))
    months = tables["orders"].groupBy("order_id").agg(F.max("order_month").alias("order_month"))
    tables["items"] = tables["items"].join(months, "order_id", "left")
    return tables


def table_path(path: str, key: str) -> str:
    return f"{path}/{FILE_NAMES[key].rsplit('.', 1)[0]}"


def write_table(key: str, df: DataFrame, path: str, mode: str = "static") -> int:
    """Write a table of ``with_months`` and return its rows, observed by the write itself.

    ``mode``: static replaces the table, dynamic only the months that ``df`` has.
    """
    month = MONTH_KEYS[key][0] if key in MONTH_KEYS else None
    seen = Observation(key)
    df = (month_ranged(df, *MONTH_KEYS[key]) if month else df).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode)
    (writer.partitionBy(month) if month else writer).parquet(table_path(path, key))
    return seen.get["rows"]


def write_counts(spark: SparkSession, counts: dict[str, int], path: str) -> None:
    rows = [(TABLE_NAMES[k], n) for k, n in counts.items()]
    spark.createDataFrame(rows, _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/{COUNTS_TABLE}")


def write_star(star: Star, path: str) -> None:
    """Persist the star as parquet (full replace, idempotent), with the row counts of the load.

    ``orders``, ``items`` (by their order's month) and ``events`` are partitioned by month, so date
    filters prune directories.  They are range-partitioned on (month, id) first: every task writes a
    contiguous run of months (few files per month directory), and a month
    larger than one task is split over several tasks instead of one.
    """
    counts = {key: write_table(key, df, path) for key, df in with_months(star).items()}
    write_counts(star.spark, counts, path)


# Facts that meet on the order id, kept as bucketed tables by ``write_bucketed``.
BUCKETED = ("orders", "items")


def write_bucketed(star: Star, schema: str, path: str, buckets: int) -> None:
    """Save ``orders`` and ``items`` as tables of database ``schema``, both in ``buckets`` buckets of the order id.

    A bucket of the one then joins the same bucket of the other without a shuffle of either; rows inside are sorted by
    the order id.  Choose ``buckets`` so that one holds a few hundred MB of lines.  The files lie under ``path``.
    """
    star.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    for key in BUCKETED:
        df = with_months(star)[key]
        (df.repartition(buckets, "order_id").write.mode("overwrite").bucketBy(buckets, "order_id").sortBy("order_id")
         .option("path", f"{path}/bucketed_{key}").saveAsTable(f"`{schema}`.`{TABLE_NAMES[key]}`"))


def read_bucketed(star: Star, schema: str) -> Star:
    """``star`` with its orders and lines read from the tables of ``write_bucketed``."""
    tables = {key: star.spark.table(f"`{schema}`.`{TABLE_NAMES[key]}`") for key in BUCKETED}
    columns = {key: SCHEMAS[key].names + (["order_month"] if key == "orders" else []) for key in BUCKETED}
    rest = {k: v for k, v in star.tables().items() if k not in BUCKETED}
    return Star(**rest, **{k: df.select(columns[k]) for k, df in tables.items()}, params=star.params,
                by_month={k: v for k, v in star.by_month.items() if k not in BUCKETED}, loaded=star.loaded)


def load_row_counts(star: Star) -> DataFrame:
    """(table_name, rows_loaded) for the seven tables: as the load observed them, else one scan each."""
    if star.loaded is not None:
        return star.loaded
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows_loaded"))
        .select(F.lit(TABLE_NAMES[k]).alias("table_name"), "rows_loaded")
        for k, df in star.tables().items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
