"""Exact global NTILE without a single-partition window.

``ntile(n) OVER (ORDER BY x)`` with no PARTITION BY makes Spark move every row
to one task (``Exchange SinglePartition``).  Instead:

1. range-partition on the sort key (ties broken by a unique id), into as many
   ranges as the number of rows asks for, and sort inside each partition;
   ``monotonically_increasing_id`` then encodes (partition index, position in
   partition);
2. checkpoint that frame (reliable checkpoint in ``spark.checkpoint.dir``) so
   both uses below see the same rows in the same places, even after an
   executor loss;
3. count rows per partition (one row per partition), prefix-sum the counts
   with a window over that tiny frame and broadcast it back;
4. global position i = partition offset + local position; the tile follows
   from i, the row count N and n:  base = N div n, r = N mod n, the first r
   tiles hold base + 1 rows.

Nothing is collected to the driver; the only single-partition step works on
one row per partition.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ratios import idiv
from .skew import pieces

_LOCAL_BITS = 33

#: Ranked (score, value, key) rows in one range, on average.
RANKS_A_RANGE = 200_000


def choose_checkpoint_dir(current: str | None, configured: str | None, master: str) -> tuple[str, bool]:
    """(directory, must_set): the context's directory, else ``spark.checkpoint.dir``;
    only a local master may fall back to a fresh temporary folder."""
    if current:
        return current, False
    if configured:
        return configured, True
    if master.startswith("local"):
        return tempfile.mkdtemp(prefix="growthlens-ckpt-"), True
    raise RuntimeError("set spark.checkpoint.dir to a shared directory (needed by distributed_ntiles)")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only local sessions get a default."""
    sc = spark.sparkContext
    path, must_set = choose_checkpoint_dir(sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None),
                                           sc.master)
    if must_set:
        sc.setCheckpointDir(path)
    return path


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def ntile_column(pos: Column, total: Column, n: int) -> Column:
    """Tile (1..n) of 1-based position ``pos`` among ``total`` rows."""
    base = idiv(total, F.lit(n))
    r = total % n
    big = r * (base + 1)
    first = idiv(pos - 1, base + 1) + 1
    rest = r + idiv(pos - big - 1, F.nullif(base, F.lit(0))) + 1
    return F.when(pos <= big, first).otherwise(rest).cast("int")


def distributed_ntiles(df: DataFrame, key: str, scores: dict[str, Column], n: int,
                       rows: DataFrame | None = None) -> DataFrame:
    """Add, for each score, ``name`` = NTILE(n) OVER (ORDER BY value, key).

    ``key`` is unique and the values are numbers (negate one to rank it descending; NULL ranks first).  All scores
    are ranked at once: narrow (score, value, key) rows, one range shuffle, one checkpoint, and the tiles joined back
    by key, whatever the width of ``df``.  ``rows`` is a table with about as many rows as ``df`` that is cheap to count
    (``skew.pieces``): the ranges follow its number.  Without it there are as many as the session's shuffle partitions.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = list(scores)
    ranges = _parts(spark) if rows is None else pieces(rows, max(RANKS_A_RANGE // len(names), 1))
    # integers rank as themselves, fractions as doubles
    whole = {name: dict(df.select(v.alias("v")).dtypes)["v"] not in ("float", "double") for name, v in scores.items()}
    entries = F.array(*[F.struct(
        F.lit(i).alias("_score"),
        (scores[name] if whole[name] else F.lit(None)).cast("long").alias("_int"),
        (F.lit(None) if whole[name] else scores[name]).cast("double").alias("_dbl")) for i, name in enumerate(names)])
    order = ["_score", "_int", "_dbl", key]
    ranged = (df.select(key, F.explode(entries).alias("_e")).select(key, "_e.*")
              .repartitionByRange(ranges, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()).select(key, "_score", "_mid").checkpoint(eager=True))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    counts = ranged.groupBy("_score", "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("_score").orderBy("_pid")
    offsets = counts.select(
        "_score", "_pid", "_first",
        (F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cnt"))
        .alias("_off"),
        F.sum("_cnt").over(Window.partitionBy("_score")).alias("_total"))
    pos = F.col("_off") + F.col("_mid") - F.col("_first") + 1
    tile = ranged.join(F.broadcast(offsets), ["_score", "_pid"]).select(
        key, "_score", ntile_column(pos, F.col("_total"), n).alias("_tile"))
    tiles = tile.groupBy(key).agg(*[F.max(F.when(F.col("_score") == i, F.col("_tile"))).alias(name)
                                    for i, name in enumerate(names)])
    return df.join(tiles, key)
