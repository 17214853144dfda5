"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``lookup`` sends this many of the heaviest keys by broadcast; what remains holds at most 1/257 of the rows a key.
HEAVY_KEYS = 256
#: ``repeated`` makes copies of a row in blocks of this many.
COPY_BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder, from ``spark.checkpoint.dir``.

    Where none is set, a session inside one machine's JVM gets a fresh one; on a cluster the executors would each write
    to a disk of their own, so that is refused.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="growthlens-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage and computes it once.

    Unlike ``checkpoint()`` the last stage runs once, and the files survive the loss of any executor.
    """
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def lookup(rows: DataFrame, mapping: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``mapping`` (one row per bigint ``key``; both non-null), safe against hot keys.

    ``weight`` counts the rows of a key.  The HEAVY_KEYS heaviest entries travel by broadcast, so their size is
    bounded whatever the data; rows of those keys are dealt by ``spread`` and match nothing in the shuffle join.
    Read ``mapping`` from a materialised table, as it is used twice.  Its other columns come back.
    """
    values = [c for c in mapping.columns if c != key]
    heavy = mapping.orderBy(F.desc(weight), key).limit(HEAVY_KEYS)
    heavy = heavy.select(F.col(key), F.struct(*values).alias("__heavy"))
    cold = mapping.select(F.col(key).alias("__key"), F.lit(True).alias("__cold"), F.struct(*values).alias("__value"))
    tagged = rows.join(F.broadcast(heavy), key, "left")
    tagged = tagged.withColumn("__cold", F.col("__heavy").isNull()).withColumn(
        "__key", F.when(F.col("__cold"), F.col(key)).otherwise(F.xxhash64(spread)))
    joined = tagged.join(cold, ["__key", "__cold"], "left")
    picked = F.coalesce("__heavy", "__value")
    return joined.select(*rows.columns, *[picked[c].alias(c) for c in values])


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Every row as often as its column ``copies`` says, without that column.

    Copies are made in blocks of COPY_BLOCK, which are dealt to all tasks in between: no array and no task holds all
    copies of one row.
    """
    block, size = fresh(rows, "block"), F.lit(COPY_BLOCK).cast("bigint")
    blocks_ = rows.withColumn(block, F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr(f"`{copies}`"), size)))
    dealt = blocks_.hint("rebalance")
    left = F.least(size, F.col(copies) - F.col(block) + 1)
    return dealt.withColumn(block, F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop(block, copies)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(batch, column: str, max_bytes: int):
    """Slices of an Arrow batch whose string or binary ``column`` sums to about ``max_bytes`` (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


#: Bytes to lower case, everything but the bytes of ASCII letters, digits and other scripts to a blank.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
              for b in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in lower case: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []
