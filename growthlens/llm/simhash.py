"""SimHash near-duplicates: 64-bit fingerprints linked through covering locality-sensitive hashing.

Every bit position gets a nonzero code of ``RADIUS + 1`` bits, and every nonzero ``v`` of as many bits makes a table
whose mask keeps the positions with an odd inner product of code and ``v``.  Any ``RADIUS`` differing positions leave
some ``v`` with even products for all of them, so that two fingerprints within the radius agree under that mask: no
pair is missed.  Equal fingerprints are one node from the start, so copies cost one row.

A bucket of two fingerprints is checked outright.  In a larger one no pairs are formed: every member names itself and
itself with one bit flipped, for the bits that vary in the bucket, and two members are within two bits exactly if they
share such a name (at most 65 fingerprints can).  So the work is linear in the bucket, however large.

Defined cases: NULL text and texts without words have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; a component's id is its least doc_id, NULL only if it has no other; repeated rows are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lookup, materialise
from .components import roots

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: A bucket's members meet its summary in this many parts.
BUCKET_PARTS = 16


def simhash(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    import pyarrow as pa

    for batch in batches:
        found = np.array([simhash(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found)], names=[*names, "fp"])


def fingerprints(docs: DataFrame, *rows: Column) -> DataFrame:
    """doc_id, the bigint columns ``rows`` (row1, row2, ...) and the fingerprint (as a signed bigint) of every row."""
    more = [c.alias(f"row{k + 1}") for k, c in enumerate(rows)]
    asked = docs.select(F.col("doc_id").cast("bigint"), *more, F.col("text").cast("binary"))
    names = ["doc_id", *[f"row{k + 1}" for k in range(len(more))], "fp"]
    return asked.mapInArrow(_fingerprints, ", ".join(f"{n} bigint" for n in names))


def masks(radius: int = RADIUS) -> list[int]:
    """One mask a table; positions get the nonzero codes in turn."""
    codes = (1 << radius + 1) - 1
    return [sum(1 << bit for bit in range(64) if ((bit % codes + 1) & v).bit_count() % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints ``fp`` (distinct) reachable by steps of at most two bits."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks())])
    members = nodes.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    buckets = materialise(members.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
        F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")).where("n > 1"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = buckets.where((F.col("n") == 2) & (apart <= RADIUS)).select("a", "b")

    large = buckets.where("n > 2").select("t", "key", "varying", F.explode(
        F.sequence(F.lit(0), F.lit(BUCKET_PARTS - 1))).alias("part"))
    crowded = members.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(BUCKET_PARTS)).cast("int")).join(
        large, ["t", "key", "part"])
    flips = F.array(*[F.lit(_signed(1 << bit)) for bit in range(64)])
    used = F.filter(flips, lambda f: f.bitwiseAND(F.col("varying")) != 0)
    names = crowded.select("fp", F.explode(F.concat(
        F.array("fp"), F.transform(used, lambda f: F.col("fp").bitwiseXOR(f)))).alias("name"))
    near = names.groupBy("name").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of every row."""
    rows = materialise(fingerprints(docs))
    nodes = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    linked = roots(links(nodes)).withColumnRenamed("node", "fp")
    linked = materialise(linked.join(nodes, "fp"))
    firsts = materialise(linked.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.min("first").alias("least")))
    named = lookup(linked.select("fp", "root"), firsts, "root", "nodes", F.col("fp")).select("fp", "least")
    mapping = materialise(nodes.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("least", "first").alias("component_id")))
    return lookup(rows, mapping, "fp", "n", F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the least doc_id, or without any id where the component has none.

    A row is known by its doc_id and a hash of its columns, so different rows of one doc_id, or without one, stay
    apart; of several rows the least hash decides, the same on every run.
    """
    key, null, row = fresh(docs, "key"), fresh(docs, "null"), fresh(docs, "row")
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = materialise(fingerprints(docs, hashed))
    nodes = materialise(rows.groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(key), F.col("row1").alias(row)
    )).alias("least")))
    linked = roots(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    first = nodes.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("least").alias("least")).select("least.*")
    known = docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias(key),
                        F.col("doc_id").isNull().alias(null), hashed.alias(row))
    kept = known.join(materialise(first), [key, null, row], "left_semi")
    return kept.dropDuplicates([key, null, row]).select(docs.columns)
