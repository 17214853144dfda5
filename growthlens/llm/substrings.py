"""Substring dedup: passages of ``WINDOW`` words or more that occur elsewhere are found with sharded FM-indexes.

Every window of a document belongs to the shard of its minimizer, the least hash of its ``MINIMIZER_WORDS``-word runs.
Equal windows have equal minimizers, so a shard's own index sees every occurrence of its windows; consecutive windows
with one minimizer travel as one segment, and each window lies in exactly one segment.  The steps:

1. Documents give narrow rows (document key, first window, windows, minimizer, hash of the words) per segment.
2. Segments whose minimizer occurs once hold only unique windows and end here; this is most of a corpus.
3. Segments with equal words are repeats as a whole, however many copies there are, and one stands for all.
4. The other segments with a shared minimizer fetch their words, meet in their shard's compressed FM-index, and
   backward search computes their matching statistics; windows with two occurrences are reported.
   A minimizer with more than ``MAX_SEGMENTS`` different segments would make a shard of its own size; its windows are
   compared by window hash instead, in parts that no key can overfill.
5. The documents drop the words that reported windows cover.

Word and window identity is by 64-bit hashes.  The keyed texts are shuffled once and used for steps 4 and 5.

Defined cases: NULL text has no words; fewer words than a window cannot repeat; equal (doc_id, text) rows are copies of
each other; a doc_id may be NULL; repeats within one document count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fresh, lookup, materialise
from .fmindex import repeated_windows

WINDOW = 35
MINIMIZER_WORDS = 8
#: Different segments of one minimizer that a shard may hold: at most a million words, well within a task's memory.
MAX_SEGMENTS = 16_000
SHARD_WORDS = 400_000
HEAVY_ROWS = 100_000
SALTS = 1024
_SCAN_BYTES = 4 << 20
_SLICE_WORDS = 100_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


_BYTE_CODES = _odd(1, _PLACES * 256)
_STEP, _LEVELS = _odd(2, 2), _odd(3, 8)
_INVERSE = np.uint64(pow(int(_STEP[0]), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP[1]
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and a 64-bit hash of every word of a byte array."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = np.zeros(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), _SLICE_WORDS):
        first, last = starts[i:i + _SLICE_WORDS], ends[i:i + _SLICE_WORDS]
        low, high = first[0], last[-1]
        place = np.arange(low, high) - np.repeat(first, np.diff(np.append(first, high)))
        codes = _BYTE_CODES[(place & (_PLACES - 1)) * 256 + data[low:high]]
        codes *= ((place // _PLACES) * 2 + 1).astype(np.uint64)
        codes[~inside[low:high]] = 0
        hashes[i:i + _SLICE_WORDS] = np.add.reduceat(codes, first - low) + (last - first).astype(np.uint64) * _LEVELS[7]
    return starts, _mixed(hashes)


def _run_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of every run of ``words`` (a power of two) consecutive words."""
    level, size = 0, 1
    while size < words:
        h = _mixed(h[:-size] * _LEVELS[level] + h[size:])
        level, size = level + 1, size * 2
    return h


def _least_of(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum of every ``width`` consecutive values and the place of its first occurrence."""
    def step(shift: int) -> None:
        nonlocal x, at
        right = x[shift:] < x[:-shift]
        x, at = np.where(right, x[shift:], x[:-shift]), np.where(right, at[shift:], at[:-shift])

    at, size = np.arange(len(x)), 1
    while size * 2 <= width:
        step(size)
        size *= 2
    if width > size:
        step(width - size)
    return x, at


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Words:
    """Word hashes of several texts laid end to end, with hashes of any range of words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        first, self.h = word_hashes(data)
        self.bounds = np.searchsorted(first, offsets)  # words of text i: bounds[i] to bounds[i + 1]
        n = len(self.h)
        power, self.down = _powers(_STEP[0], n), _powers(_INVERSE, n)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * power[:-1])])

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.prefix[end] - self.prefix[start]) * self.down[start])

    def segments(self, window: int):
        """Arrays (text, first word, windows, minimizer, hash): the runs of windows with one minimizer.

        A run keeps to one place of its minimizer, so two equal windows never share a run.
        """
        n = len(self.h)
        if n < window:
            return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)] * 2
        least, place = _least_of(_run_hashes(self.h, MINIMIZER_WORDS), window - MINIMIZER_WORDS + 1)
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        valid = owner[:n - window + 1] == owner[window - 1:]
        change = np.ones(len(least), dtype=bool)
        change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        heads = np.flatnonzero(change)
        # a run ends before the next head or where its document's windows end
        last_valid = np.maximum(self.bounds[1:] - window + 1, self.bounds[:-1])
        sizes = np.minimum(np.concatenate([heads[1:], [len(least)]]), last_valid[owner[heads]]) - heads
        keep = valid[heads]
        heads, sizes = heads[keep], sizes[keep]
        text = owner[heads]
        return (text, heads - self.bounds[text], sizes, least[heads],
                self.range_hash(heads, heads + sizes + window - 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _segment_rows(window: int):
    def segments(batches):
        import pyarrow as pa

        for batch in batches:
            for block in blocks(batch, "text", _SCAN_BYTES):
                keys = block.column("dk").to_numpy(zero_copy_only=False)
                text, first, size, least, content = Words([t or b"" for t in block.column("text").to_pylist()]
                                                          ).segments(window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[text]), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(_signed(least)), pa.array(_signed(content))], names=["dk", "s", "n", "m", "g"])

    return segments


_ASKED = "dk bigint, s int, n int, route bigint, key bigint, query boolean, words binary"


def _fetch(window: int, shards: int, heavy: int, key: str, listed: str):
    """For mapInArrow: words of the listed segments, each with its shard; single windows of heavy minimizers."""
    def fetch(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        names = ["dk", "s", "n", "route", "key", "query", "words"]
        for batch in batches:
            for block in blocks(batch, "text", _SCAN_BYTES):
                keys, asked = block.column(key).to_pylist(), block.column(listed).to_pylist()
                words = Words([t or b"" for t in block.column("text").to_pylist()])
                rows = []
                for dk, base, mine in zip(keys, words.bounds.tolist(), asked):
                    for x in mine:
                        a, b = base + x["s"], base + x["s"] + x["n"]
                        if not x["heavy"]:
                            rows.append((dk, x["s"], x["n"], x["m"] % shards, x["m"], x["query"],
                                         words.h[a:b + window - 1].tobytes()))
                            continue
                        at = np.arange(a, b)
                        for i, w in enumerate(_signed(words.range_hash(at, at + window)).tolist()):
                            salt = (dk ^ (x["s"] + i) * 0x9E3779B1) % SALTS
                            rows.append((dk, x["s"] + i, 1, shards + (w ^ salt * 0x85EBCA77) % heavy, w, x["query"],
                                         None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return fetch


_FOUND = "dk bigint, s int, n int, key bigint, sure boolean"


def _search(window: int, shards: int):
    """For applyInArrow: repeated window ranges of a shard, or what one part of the heavy windows can tell."""
    def shard(table):
        import pyarrow as pa

        dk, s = table.column("dk").to_numpy(), table.column("s").to_numpy()
        query = table.column("query").to_numpy()
        sequences = [np.frombuffer(w, dtype=np.uint64) for w in table.column("words").to_pylist()]
        _, flat = np.unique(np.concatenate(sequences), return_inverse=True)
        flat = flat + 2
        cut = np.cumsum([len(x) for x in sequences])[:-1]
        asked = np.flatnonzero(query)
        if not len(asked):
            return [[]] * 5
        found = repeated_windows(np.split(flat, cut), asked.tolist(), int(flat.max()) + 1, window)
        rows = []
        for q, hit in zip(asked, found):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            rows += [(int(dk[q]), int(s[q] + a), int(b - a), 0, True) for a, b in zip(edges[::2], edges[1::2])]
        return list(zip(*rows)) or [[]] * 5

    def windows(table):
        """Windows met twice here are sure; one row of every key goes on, to be compared with the other parts."""
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        many = np.diff(np.concatenate([np.flatnonzero(head), [len(key)]]))
        sure = np.repeat(many > 1, many)
        dk, s = table.column("dk").to_numpy()[order], table.column("s").to_numpy()[order]
        one = np.ones(int(head.sum()), dtype=np.int32)
        return [np.concatenate([dk[sure], dk[head]]), np.concatenate([s[sure], s[head]]),
                np.concatenate([np.ones(int(sure.sum()), dtype=np.int32), one]),
                np.concatenate([ordered[sure], ordered[head]]),
                np.concatenate([np.ones(int(sure.sum()), dtype=bool), np.zeros(len(one), dtype=bool)])]

    def search(table):
        import pyarrow as pa

        columns = shard(table) if table.column("route")[0].as_py() < shards else windows(table)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                    names=["dk", "s", "n", "key", "sure"])

    return search


def _remover(window: int, text: str, out: str, schema: T.StructType):
    def remove(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field(out).type
        for batch in batches:
            for block in blocks(batch, text, _SCAN_BYTES):
                rows = []
                texts = block.column(text).cast(pa.binary()).to_pylist()  # a string column may hold any bytes
                for t, had in zip(texts, block.column(out).to_pylist()):
                    words = t.split() if t else []
                    kept = words
                    if had["hits"]:
                        keep = np.ones(len(words), dtype=bool)
                        for h in had["hits"]:
                            keep[h["s"]:h["s"] + h["n"] + window - 1] = False
                        kept = [words[i] for i in np.flatnonzero(keep)]
                    rows.append({"n_words": len(words), "n_removed": len(words) - len(kept),
                                 "kept": b" ".join(kept).decode("utf-8", "replace"), "hits": []})
                at = block.schema.get_field_index(out)
                yield block.set_column(at, pa.field(out, kind), pa.array(rows, type=kind))

    return remove


def _candidates(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments that are repeats as a whole (dk, s, n), and those that need their words (also m, query, heavy)."""
    dk = F.col("dk")
    shared = materialise(runs.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    again = materialise(lookup(runs, shared, "m", "c", dk).where(F.col("c").isNotNull()).drop("c")
                        .withColumn("mg", F.xxhash64("m", "g")))
    equal = materialise(again.groupBy("m", "g", "mg").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("dk", "s", "n")).alias("one")))
    whole = lookup(again, equal.select("mg", "copies"), "mg", "copies", dk).where("copies > 1").select("dk", "s", "n")
    mixed = materialise(equal.groupBy("m").agg(F.count(F.lit(1)).alias("different"),
                                               F.min("copies").alias("fewest")))
    each = equal.select("m", "copies", "one.*")
    asked = lookup(each, mixed, "m", "different", F.col("dk")).where("fewest = 1").select(
        "dk", "s", "n", "m", (F.col("copies") == 1).alias("query"), (F.col("different") > MAX_SEGMENTS).alias("heavy"))
    return whole, materialise(asked)


def deduplicate(docs: DataFrame, window: int = WINDOW, out: str = "repeats") -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_removed, kept (the words left, joined by blanks)."""
    key, listed, hit = fresh(docs, "dk"), fresh(docs, "asked"), fresh(docs, "hit_list")
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)),
                                            F.col("doc_id").isNull(), body))
    runs = materialise(keyed.select(F.col(key).alias("dk"), body.cast("binary").alias("text"))
                       .mapInArrow(_segment_rows(window), "dk bigint, s int, n int, m bigint, g bigint"))
    whole, asked = _candidates(runs)
    load = asked.agg(F.sum(F.when(~F.col("heavy"), F.col("n") + window)).alias("words"),
                     F.sum(F.when(F.col("heavy"), F.col("n"))).alias("windows")).first()
    shards, heavy = 1 + (load.words or 0) // SHARD_WORDS, 1 + (load.windows or 0) // HEAVY_ROWS

    lists = asked.groupBy(F.col("dk").alias(key)).agg(
        F.collect_list(F.struct("s", "n", "m", "query", "heavy")).alias(listed))
    # all columns go along, so that this join and the last one share the exchange of the texts
    named = keyed.join(lists, key).withColumn("text", F.col("text").cast("binary"))
    fetched = named.mapInArrow(_fetch(window, shards, heavy, key, listed), _ASKED)
    told = fetched.groupBy("route").applyInArrow(_search(window, shards), _FOUND)
    meet = Window.partitionBy(F.when(F.col("sure"), F.xxhash64("dk", "s")).otherwise(F.col("key")), "sure")
    told = told.withColumn("met", F.count(F.lit(1)).over(meet)).where("sure or met > 1").select("dk", "s", "n")
    hits = whole.unionByName(told).distinct().groupBy(F.col("dk").alias(key)).agg(
        F.collect_list(F.struct("s", "n")).alias(hit))
    both = keyed.join(hits, key, "left").withColumn(out, F.struct(
        F.lit(0).alias("n_words"), F.lit(0).alias("n_removed"), F.lit("").alias("kept"),
        F.coalesce(hit, F.array().cast("array<struct<s: int, n: int>>")).alias("hits"))).drop(hit, key)
    return both.mapInArrow(_remover(window, "text", out, both.schema), both.schema).withColumn(
        out, F.col(out).dropFields("hits"))


def report(docs: DataFrame) -> DataFrame:
    found = deduplicate(docs.select("doc_id", "text"))
    return found.select("doc_id", F.col("repeats.n_words").cast("bigint").alias("n_words"),
                        F.col("repeats.n_removed").cast("bigint").alias("n_removed"),
                        F.sha2("repeats.kept", 256).alias("kept_sha256"))


#: The registered query in DuckDB's SQL: windows meet by their digests.
SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p
  FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS left_over
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split) ANTI JOIN covered USING (r, p)
  GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM covered GROUP BY r) USING (r)
"""
