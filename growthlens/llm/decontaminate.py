"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, and a scan of every document.

A benchmark item's windows are its runs of ``WINDOW`` words (a shorter item is one window).  The scan turns a
document's words into the benchmark's word numbers, looks the hash of each all-known window up in the set, compares
the words of a hit, and marks the words that any true hit covers.

The set goes to the executors as a broadcast only up to about ``MAX_BLOCK_WORDS`` benchmark words.  The texts of a
larger benchmark are cut into pieces of ``PIECE_WORDS`` words that overlap by a window less a word, the pieces are dealt
into blocks, and the documents are scanned once per block; one item may be spread over all blocks.

Defined cases: NULL text has no words and no hits; items without words have no windows; rows of one item_id count as
one item, a NULL item_id as the item ``null``; an empty benchmark hits nothing; repeated documents are kept.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fold_words, fresh, materialise

WINDOW = 10
MAX_BLOCK_WORDS = 4_000_000
PIECE_WORDS = 100_000
_SCAN_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class WindowSet:
    """Windows by length: sorted hashes for the scan, and the items of each window by its exact words."""

    def __init__(self, vocabulary: dict[bytes, int], windows: dict[int, dict[bytes, set[str]]]):
        self.vocabulary, self.windows = vocabulary, windows
        self.hashes = {size: np.unique(self._hash(np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, size)))
                       for size, found in windows.items()}

    @staticmethod
    def collect(items: list[tuple[str, bytes]]) -> tuple[dict, dict]:
        """The word numbers and the windows of the items, as plain dicts to broadcast."""
        vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in fold_words(text)],
                               dtype=np.int64)
            size = min(WINDOW, len(numbers))
            for i in range(len(numbers) - size + 1 if size else 0):
                windows.setdefault(size, {}).setdefault(numbers[i:i + size].tobytes(), set()).add(item)
        return vocabulary, windows

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            total = (total + rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def find(self, numbers: np.ndarray):
        """(start, size, items) of every occurrence of a window; 0 marks words outside the vocabulary."""
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        for size, hashes in self.hashes.items():
            if len(numbers) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            for part in np.array_split(starts, len(starts) // 500_000 + 1):
                rows = numbers[part[:, None] + np.arange(size)]
                seen = self._hash(rows)
                at = np.minimum(np.searchsorted(hashes, seen), len(hashes) - 1)
                for i in np.flatnonzero(hashes[at] == seen):
                    items = self.windows[size].get(rows[i].tobytes())
                    if items:
                        yield int(part[i]), size, items


def _runs(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _scanner(shared, text: str, out: str, schema: T.StructType):
    """For mapInArrow: adds to the struct ``out`` what the windows of ``shared`` find in the binary column ``text``."""
    def scan(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field(out).type
        index = WindowSet(*shared.value)
        for batch in batches:
            for block in blocks(batch, text, _SCAN_BYTES):
                lists = [fold_words(t) for t in block.column(text).to_pylist()]
                bounds = np.cumsum([0] + [len(x) + 1 for x in lists])
                numbers = np.zeros(bounds[-1], dtype=np.int64)
                for a, words in zip(bounds, lists):
                    numbers[a:a + len(words)] = index.numbers(words)
                found: dict[int, tuple[list, set]] = {}
                for start, size, items in index.find(numbers):
                    doc = int(np.searchsorted(bounds, start, side="right")) - 1
                    spans, names = found.setdefault(doc, ([], set()))
                    spans.append((start - int(bounds[doc]), size))
                    names.update(items)
                before = block.column(out).to_pylist()
                after = []
                for doc, (words, had) in enumerate(zip(lists, before)):
                    hits, names = had["hits"], set(had["items"])
                    if doc in found:
                        mask = np.zeros(len(words), dtype=bool)
                        for a, n in [(h["start"], h["end"] - h["start"]) for h in hits] + found[doc][0]:
                            mask[a:a + n] = True
                        hits, names = _runs(mask), names | found[doc][1]
                    after.append({"n_words": len(words), "hits": hits, "items": sorted(names)})
                at = block.schema.get_field_index(out)
                yield block.set_column(at, pa.field(out, kind), pa.array(after, type=kind))

    return scan


def _pieces(batches):
    """Benchmark texts in lower case, cut into pieces that between them hold every window of a text once or twice."""
    import pyarrow as pa

    step = PIECE_WORDS - WINDOW + 1
    for batch in batches:
        for block in blocks(batch, "text", _SCAN_BYTES):
            rows = []
            for item, text in zip(block.column("item").to_pylist(), block.column("text").to_pylist()):
                words = fold_words(text)
                for a in range(0, max(1, len(words) - WINDOW + 1), step):
                    part = words[a:a + PIECE_WORDS]
                    rows.append((item, a // step, len(part), b" ".join(part)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["item", "piece", "words", "text"])


def scan(docs: DataFrame, benchmark: DataFrame, out: str = "benchmark") -> DataFrame:
    """``docs`` with the struct ``out``: n_words, hits (word ranges) and items (ids, as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                             F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    pieces = materialise(items.mapInArrow(_pieces, "item string, piece bigint, words bigint, text binary"))
    n_blocks = max(1, -(-(pieces.agg(F.sum("words")).first()[0] or 0) // MAX_BLOCK_WORDS))
    text = fresh(docs, "scanned")
    empty = F.struct(F.lit(0).alias("n_words"), F.array().cast(_HITS).alias("hits"),
                     F.array().cast("array<string>").alias("items"))
    found = docs.withColumn(text, F.col("text").cast("binary")).withColumn(out, empty)
    for b in range(n_blocks):
        dealt = F.pmod(F.xxhash64("item", "piece", "text"), F.lit(n_blocks))
        mine = pieces.where(dealt == b).select("item", "text").distinct().collect()
        shared = spark.sparkContext.broadcast(WindowSet.collect([(r.item, bytes(r.text)) for r in mine]))
        found = found.mapInArrow(_scanner(shared, text, out, found.schema), found.schema)
        if b + 1 < n_blocks:
            found = materialise(found)
    return found.drop(text)


def _covered(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda total, h: total + h["end"] - h["start"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: its words, those hit, the items found and their digest."""
    found = scan(docs.select("doc_id", "text"), benchmark, "b").drop("text")
    return found.select(
        "doc_id", F.col("b.n_words").cast("bigint").alias("n_words"), _covered(F.col("b.hits")).alias("n_hit"),
        F.size("b.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("b.items"), ","), 256).alias("items_sha256"),
        (F.size("b.hits") > 0).alias("contaminated"))


def without_spans(text: bytes | None, hits: list[dict]) -> bytes | None:
    """``text`` without the bytes from the first to the last word of each hit range."""
    if not text or not hits:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    kept, done = [], 0
    for h in hits:
        kept.append(text[done:at[h["start"]][0]])
        done = at[h["end"] - 1][1]
    return b"".join(kept) + text[done:]


def _stripper(text: str, out: str):
    def strip(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(text).to_pylist()]
            cleaned = [without_spans(t, r["hits"]) for t, r in zip(texts, batch.column(out).to_pylist())]
            at = batch.schema.get_field_index(text)
            array = pa.array([None if t is None else t.decode() for t in cleaned], type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), array)

    return strip


def clean(docs: DataFrame, benchmark: DataFrame, drop: bool = True) -> DataFrame:
    """``docs`` without contaminated documents, or (``drop=False``) without the contaminated spans of their texts."""
    out = fresh(docs, "benchmark")
    found = scan(docs, benchmark, out)
    if drop:
        return found.where(F.size(F.col(out)["hits"]) == 0).drop(out)
    return found.mapInArrow(_stripper("text", out), found.schema).drop(out)


#: The registered query in DuckDB's SQL: windows meet as strings.
SQL = r"""
WITH folded AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
asked AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
seen AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM folded JOIN (SELECT DISTINCT size FROM asked) ON len(w) >= size)),
hits AS (SELECT r, i, size, item FROM seen JOIN asked USING (size, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM folded LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
