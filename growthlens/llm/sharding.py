"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

A document's ring point is the hash of its text, so equal texts stay together where a shard has room.  A point
belongs to the next virtual node clockwise.  No shard may hold more than ``1 + SLACK`` times the mean bytes; what
overflows a full shard continues clockwise to the next one with room.

The decision is made on sums: Spark adds up the bytes of each arc (at most shards x VNODES of them) and the driver
walks the ring once over those sums, noting which byte range of an arc goes to which shard.  Rows larger than
1/ROCKS of a mean shard, of which there can be at most shards x ROCKS, are placed first and one by one, largest
first, so that every other row moves a boundary by less than that.  A row then finds its shard by its byte offset in
its arc: prefix sums over cells of an arc (more cells for a heavy arc, so one text that holds a third of all rows is
spread) and a running sum inside a cell.

Defined cases: NULL text has no bytes; equal rows are interchangeable; a NULL doc_id sorts first; an empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 24
VNODES = 64
SLOTS = 1 << 14
SLACK = 0.0002
ROCKS = 1000
OVERHEAD_BYTES = 8


def _spread(x: int) -> int:
    x = (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
    return x ^ (x >> 32)


def ring(shards: int) -> list[tuple[int, int]]:
    """(slot, shard) of the virtual nodes in ring order; the smaller shard keeps a slot that two would take."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(VNODES):
            nodes.setdefault(_spread(shard * 4096 + v) % SLOTS, shard)
    return sorted(nodes.items())


def arc_of(nodes: list[tuple[int, int]]) -> list[int]:
    """The arc (index of the next virtual node clockwise) of every slot."""
    at = [slot for slot, _ in nodes]
    return [bisect_left(at, slot) % len(at) for slot in range(SLOTS)]


def place(nodes: list[tuple[int, int]], shards: int, capacity: int, rocks: list[tuple[int, int]],
          loads: dict[int, int]) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Shards of the rocks, given as (arc, size), and (arc, from byte, to byte, shard) for the rest."""
    room = [capacity] * shards
    taken = []
    for arc, size in rocks:
        clockwise = (nodes[(arc + k) % len(nodes)][1] for k in range(len(nodes)))
        shard = next((s for s in clockwise if room[s] >= size), max(range(shards), key=lambda s: (room[s], -s)))
        room[shard] -= size
        taken.append(shard)
    cuts = []
    for arc in sorted(loads):
        done, k = 0, 0
        while done < loads[arc]:
            last = k >= len(nodes)
            shard = max(range(shards), key=lambda s: (room[s], -s)) if last else nodes[(arc + k) % len(nodes)][1]
            share = loads[arc] - done if last else min(loads[arc] - done, max(0, room[shard]))
            if share:
                cuts.append((arc, done, done + share, shard))
                room[shard] -= share
                done += share
            k += 1
    return taken, cuts


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and the row's gapless slot in its shard."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialise(docs.select("doc_id", text.alias("text")).select(
        "doc_id", (F.octet_length("text") + OVERHEAD_BYTES).cast("bigint").alias("size"),
        F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("point")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = -int(-total * (1 + SLACK) // shards)
    is_rock = F.col("size") * (ROCKS * shards) > total
    nodes = ring(shards)
    arcs = arc_of(nodes)
    slots = F.broadcast(spark.createDataFrame(list(enumerate(arcs)), "slot int, arc int"))
    rows = rows.withColumn("slot", F.pmod("point", F.lit(SLOTS)).cast("int"))

    big = rows.where(is_rock).join(slots, "slot").select(
        "doc_id", "size", "text_crc32", "point", "arc",
        F.row_number().over(Window.partitionBy("doc_id", "point", "size").orderBy("text_crc32")).alias("copy"))
    rocks = sorted(big.select("size", "point", "doc_id", "copy", "arc").collect(),
                   key=lambda r: (-r.size, r.point, r.doc_id is not None, r.doc_id or 0, r.copy))
    small = rows.where(~is_rock).join(slots, "slot")
    sums = small.groupBy("arc").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    taken, cuts = place(nodes, shards, capacity, [(r.arc, r.size) for r in rocks], {r.arc: r.bytes for r in sums})

    where = spark.createDataFrame([(r.doc_id, r.point, r.size, r.copy, s) for r, s in zip(rocks, taken)],
                                  "id bigint, at bigint, bytes bigint, nth int, shard int")
    placed = big.join(F.broadcast(where), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("point") == F.col("at"))
                      & (F.col("size") == F.col("bytes")) & (F.col("copy") == F.col("nth"))).select(
        "doc_id", "size", "text_crc32", "point", F.lit(-1).alias("arc"), F.col("shard").alias("cell"), "shard")

    per_cell = max(1, 2 * count // len(nodes))
    cells = spark.createDataFrame([(r.arc, -(-r.n // per_cell)) for r in sums], "arc int, cells int")
    cut_table = spark.createDataFrame(cuts, "cut_arc int, low bigint, high bigint, shard int")
    small = small.join(F.broadcast(cells), "arc").withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "point"), F.col("cells")).cast("int"))
    before = F.sum("bytes").over(Window.partitionBy("arc").orderBy("cell")) - F.col("bytes")
    bases = small.groupBy("arc", "cell").agg(F.sum("size").alias("bytes")).select("arc", "cell", before.alias("base"))
    inside = Window.partitionBy("arc", "cell").orderBy("point", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offset = F.col("base") + F.col("reach") - F.col("size")
    spread = small.withColumn("reach", F.sum("size").over(inside)).join(F.broadcast(bases), ["arc", "cell"]).join(
        F.broadcast(cut_table), (F.col("arc") == F.col("cut_arc")) & (offset >= F.col("low")) & (offset < F.col("high")))
    both = spread.select(placed.columns).unionByName(placed)
    nth = F.row_number().over(Window.partitionBy("shard", "arc", "cell").orderBy("point", "doc_id"))
    both = materialise(both.withColumn("nth", nth))
    counts = both.groupBy("shard", "arc", "cell").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("arc", "cell")) - F.col("n")
    counts = counts.select("shard", "arc", "cell", start.alias("start"))
    return both.join(F.broadcast(counts), ["shard", "arc", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("bigint").alias("slot"))
