"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Everything is a column expression: a text's five-word shingles are hashed once, the top bits of a hash name its bin
and each bin keeps its least hash.  An empty bin borrows from another bin that its own probe sequence reaches first
(a new independent draw for each bin and attempt); after ``PROBES`` draws the bin of least rank in a random order of
the filled ones is taken, so the search ends whatever the text.  Four low-order bits of each bin are packed, sixteen
to a bigint; two sketches agree by chance in 1/16 of their bins, which the likeness corrects for.

Defined cases: NULL text is empty; fewer than five words make one shingle; a text without words has the all-zero
sketch, is like another such text (1.0) and unlike any other (0.0).  Repeated (doc_id, text) rows give one result row
each, with one common neighbour; other ties of doc_id are ordered by text hash; a NULL doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, repeated

BINS = 256
BITS = 4
SHINGLE_WORDS = 5
PROBES = 12
_MASK64 = (1 << 64) - 1


def _mix(x: int) -> int:
    """A 64-bit finaliser for the fixed probe table."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK64
    return x ^ (x >> 31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """One hash per shingle of ``size`` words; one for the whole of a shorter text; none for no words."""
    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
                           lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))
        return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _bins(hashes: Column) -> Column:
    """The least hash of each bin in a fixed order of the bins, NULL where a bin got none.

    The low bit of a hash is dropped; one sentinel per bin, last in its bin, carries a one there.
    """
    top = 64 - (BINS - 1).bit_length()
    sentinels = F.array(*[F.lit(_signed(((b + 1) << top) - 1)) for b in range(BINS)])
    ordered = F.sort_array(F.concat(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(-2))), sentinels))

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, top)
                                                    != F.shiftrightunsigned(s[F.greatest(i - 1, F.lit(0))], top)))

    return F.transform(let(ordered, least), lambda x: F.when(x.bitwiseAND(F.lit(1)) == 0, x))


def _densified(bins: Column) -> Column:
    """Every bin's own or borrowed value, hashed with the bin's number; NULL if no bin is filled.

    Without that, one value that fills many bins would agree with another in all of their low bits at once.
    """
    probes = F.array(*[F.lit(_mix(r * BINS + j) % BINS) for r in range(PROBES) for j in range(BINS)])

    def filled(b: Column) -> Column:
        def last(j: Column, full: Column) -> Column:
            return F.array_min(F.transform(full, lambda m: F.struct(F.xxhash64(j, m), b[m])))["col2"]

        def fill(full: Column) -> Column:
            value = lambda x, j: F.coalesce(x, *[b[probes[j + r * BINS]] for r in range(PROBES)], last(j, full))
            return F.when(F.size(full) > 0, F.transform(b, lambda x, j: F.xxhash64(value(x, j), j)))

        return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda m: b[m].isNotNull()), fill)

    return let(bins, filled)


def sketch(text: Column) -> Column:
    """The packed fingerprint, an array of ``BINS * BITS / 64`` bigints."""
    lanes = 64 // BITS

    def packed(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // lanes - 1)), lambda w: F.aggregate(
            F.slice(v, w * lanes + 1, F.lit(lanes)), F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))))

    none = F.array_repeat(F.lit(0).cast("bigint"), BINS)
    return let(F.coalesce(_densified(_bins(shingle_hashes(text))), none), packed)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(a: Column, b: Column, empty_a: Column, empty_b: Column) -> Column:
    """Estimated share of common shingles, corrected for the chance agreement of ``BITS`` bits."""
    def differing(d: Column) -> Column:
        spread = d
        for k in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(spread.bitwiseAND(F.lit(0x1111111111111111)))

    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), differing)), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    share = (F.lit(1.0) - unlike / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return F.when(empty_a | empty_b, (empty_a & empty_b).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def no_words(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[^ \t-\r]")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the packed fingerprint of every row; no shuffle."""
    return docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
                       sketch(F.col("text")).alias("sketch"))


def _predecessors(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text) row, the row before it in descending order (the first: the last one).

    Narrow rows are range-partitioned and stitched with one row per partition; no task sees the whole order.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.struct("doc_id", "key", "id", "n_chars", "copies")
    narrow = docs.groupBy("id", "key").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"),
                                           F.count(F.lit(1)).alias("copies"))
    placed = materialise(narrow.repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), F.col("key").desc())
                         .withColumn("part", F.spark_partition_id()))
    ends = placed.groupBy("part").agg(F.min(row).alias("last"))
    every = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(every), F.last("last").over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("key").desc())
    return (placed.withColumn("before", F.lag(row).over(inside)).join(F.broadcast(ends), "part")
            .select("id", "key", F.coalesce("before", "edge").alias("to")))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document in descending doc_id.

    The edited text keeps the first half and takes the rest from the head of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("key"))
    before = _predecessors(keyed.select("doc_id", "id", "key", F.char_length("text").cast("bigint").alias("n_chars")))
    rows = (keyed.withColumn("sketch", sketch(F.col("text"))).groupBy("id", "key")
            .agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")))  # both uses share one exchange
    lent = rows.join(before, ["id", "key"]).select(
        F.col("to.id").alias("id"), F.col("to.key").alias("key"), F.col("to.n_chars").alias("n_chars"),
        F.col("to.doc_id").alias("doc_id"), F.col("to.copies").alias("copies"), F.col("sketch").alias("next_sketch"), no_words(F.col("text")).alias("next_empty"),
        F.expr("substring(text, 1, cast(to.n_chars div 2 as int))").alias("head"))
    edited = rows.join(lent, ["id", "key"]).withColumn(
        "edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), head)"))
    edited = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    bare = no_words(F.col("text"))
    found = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("sketch")).alias("fingerprint"),
        as_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), bare, no_words(F.col("edited"))).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), bare, F.col("next_empty")).alias("near_next"),
        "copies")
    return repeated(found, "copies")
