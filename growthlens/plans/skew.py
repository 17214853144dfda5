"""Joining row-level facts to one-row-per-key frames when a key may be hot.

``join_per_key(rows, per_key, key, hot_rows)``: the usual plan shuffles both
sides on ``key``, so a customer owning a third of all orders becomes one task
holding a third of the data.  The planner's skew-join split does not help when
the per-key side is an aggregate already partitioned by the key (no separate
shuffle stage on that side to split against).  Here:

1. a partial (map-side combined) count per key finds the hot keys, those with
   more than ``hot_rows`` rows; the MAX_HOT_KEYS heaviest of them are listed, so
   the list and its per-key rows have a fixed size bound;
2. rows of hot keys are joined in place against the broadcast per-key rows
   (no shuffle of those rows at all);
3. the remaining rows take the ordinary shuffle join, where a key holds at most
   ``hot_rows`` rows or 1 / MAX_HOT_KEYS of them.

Every row goes to exactly one branch, so inner and left joins keep their
meaning; nothing is sampled or dropped (rows with a NULL key, which match
nothing, skip the join: dropped by an inner join, kept by a left join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The heaviest keys only: the broadcast list stays this short however much data there is.
MAX_HOT_KEYS = 4096


def hot_keys(rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, the MAX_HOT_KEYS heaviest at most."""
    return (rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > hot_rows)
            .orderBy(F.desc("_n"), key).limit(MAX_HOT_KEYS).select(key))


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, hot_rows: int,
                 how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows.join(per_key, key, how)`` with hot keys joined by broadcast.

    ``per_key`` must hold at most one row per ``key``; ``how`` is ``inner`` or
    ``left`` (``rows`` on the left).  ``hot`` may supply the hot-key list from
    a cheaper frame with the same key distribution (e.g. ``hot_keys`` of the
    orders behind a derived order frame); it is broadcast, so it must carry the
    same size bound.  Which branch a key takes never changes the result.
    """
    if how not in ("inner", "left"):
        raise ValueError("join_per_key supports inner and left joins")
    # NULL keys never match; kept out of the shuffle join, where they would all hash to one task
    null_rows = rows.filter(F.col(key).isNull())
    rows = rows.filter(F.col(key).isNotNull())
    hot = hot_keys(rows, key, hot_rows) if hot is None else hot.select(key).distinct()
    hot_side = per_key.join(F.broadcast(hot), key, "left_semi")   # <= count(rows)/hot_rows rows
    tagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(1))), key, "left")
    in_hot = F.col("_hot").isNotNull()
    hot_part = tagged.filter(in_hot).drop("_hot").join(F.broadcast(hot_side), key, how)
    cold_part = tagged.filter(~in_hot).drop("_hot").join(per_key, key, how)
    out = hot_part.unionByName(cold_part)
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in per_key.schema.fields if f.name != key]
        out = out.unionByName(null_rows.select("*", *missing))
    return out


def pieces(rows: DataFrame, rows_a_piece: int) -> int:
    """How many pieces to deal ``rows`` into: one a core, and more as the table grows.

    Narrow rows of integers take a twentieth of the room in a shuffle that they take in the hash maps and sorts behind it,
    so pieces that adaptive execution merges by shuffled bytes fill a task's memory.  ``rows`` is a plain scan: parquet
    files are counted by their footers.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_a_piece))
