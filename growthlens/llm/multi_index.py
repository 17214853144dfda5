"""Inverted multi-index: two half-space codebooks whose pairs of codewords are the cells of the vectors.

The codebooks are fitted on at most SAMPLE_ROWS vectors; every vector is put into its cell.  A codeword's radius is
the greatest distance of any vector's half to it, so that ``q.c + |q| r`` bounds the half inner product of a query with
all vectors of the codeword, and the sum of two such bounds holds for a cell.  Rows are kept in shards of consecutive
cells; a cell larger than a shard is dealt over several, so a vector that very many rows share is no hot spot.

``visit`` is the multi-sequence search over the cells of one shard: a heap yields them in descending order of bound,
in windows of some rows, until the caller is satisfied with the bound of everything that is left.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import stacked

CODEWORDS = 32
#: The codebooks are fitted on at most this many rows, picked by a hash of the row.
SAMPLE_ROWS = 8192
ROUNDS = 8
SHARD_ROWS = 2048
#: Cells are visited in windows of about this many rows.
WINDOW_ROWS = 512


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centroids by Lloyd's rounds, started on rows spread evenly over the different ones."""
    different = np.unique(x, axis=0)
    start = different[np.random.default_rng(7).permutation(len(different))[:k]].astype(np.float64)
    for _ in range(ROUNDS):
        nearest = codes(x, start)
        for c in range(len(start)):
            mine = x[nearest == c]
            if len(mine):
                start[c] = mine.mean(axis=0)
    return start


def codes(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(axis=1) - 2.0 * (x @ centroids.T), axis=1)


@dataclass(frozen=True)
class Books:
    """The codebooks of the first ``half`` components and of the rest, and their radii (over all rows)."""

    half: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]

    @property
    def width(self) -> int:
        return self.words[0].shape[1] + self.words[1].shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def words_for(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The codewords for vectors of ``width`` components; the further ones of a codeword are zero."""
        second = self.words[1]
        return self.words[0], np.pad(second, ((0, 0), (0, width - self.half - second.shape[1])))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the half inner products of the queries (rows of ``q``) with the vectors of each codeword."""
        out = []
        for part, words, radii in zip(self.halves(q), self.words_for(q.shape[1]), self.radii):
            length = np.sqrt((part ** 2).sum(axis=1))[:, None]
            slack = 1e-9 * length * (np.sqrt((words ** 2).sum(axis=1)) + radii) + 1e-6  # rounding of doubles
            out.append(part @ words.T + length * radii + slack)
        return out[0], out[1]


def fit(rows: DataFrame) -> Books:
    """Codebooks, still without radii, of the int32 vectors ``v`` of ``rows``."""
    picked = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).collect()
    x = stacked([bytes(r.v) for r in picked], "<i4", 2).astype(np.float64)
    half = x.shape[1] // 2
    if not len(x):
        x = np.zeros((1, 2))
    words = tuple(kmeans(part, CODEWORDS) for part in (x[:, :half], x[:, half:]))
    return Books(half, words, tuple(np.zeros(len(w)) for w in words))


def _coded(books: Books):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = stacked(batch.column("v").to_pylist(), "<i4", books.width).astype(np.float64)
            found = []
            for part, words in zip(books.halves(x), books.words_for(x.shape[1])):
                c = codes(part, words) if len(x) else np.zeros(0, dtype=np.int64)
                found += [pa.array(c.astype(np.int32)), pa.array(np.sqrt(((part - words[c]) ** 2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "c1", "r1", "c2", "r2"])
    return run


@dataclass(frozen=True)
class Layout:
    """The codebooks with radii, the number of rows of each cell and where they start in the order of the cells."""

    books: Books
    starts: np.ndarray
    sizes: np.ndarray

    def shards_of(self, cells: np.ndarray) -> np.ndarray:
        """The shards that hold rows of the given (flat) cells."""
        cells = cells[self.sizes[cells] > 0]
        first, last = self.starts[cells] // SHARD_ROWS, (self.starts[cells] + self.sizes[cells] - 1) // SHARD_ROWS
        steps = last - first + 1
        inner = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        return np.unique(np.repeat(first, steps) + inner)


def build(rows: DataFrame) -> tuple[DataFrame, Layout]:
    """The rows with their codewords and shard, and the layout, of ``rows`` (rid, v, ...).

    ``rid`` is a unique bigint, ``v`` a vector of little-endian int32.
    """
    books = fit(rows)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    coded = materialise(rows.mapInArrow(_coded(books), schema + ", c1 int, r1 double, c2 int, r2 double"))
    cells = coded.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"),
                                          F.max("r2").alias("r2")).collect()  # at most CODEWORDS ** 2
    radii = tuple(np.zeros(len(w)) for w in books.words)
    sizes = np.zeros(len(radii[0]) * len(radii[1]), dtype=np.int64)
    for r in cells:
        radii[0][r.c1], radii[1][r.c2] = max(radii[0][r.c1], r.r1), max(radii[1][r.c2], r.r2)
        sizes[r.c1 * len(radii[1]) + r.c2] = r.n
    starts = np.cumsum(sizes) - sizes
    cell = (F.col("c1") * len(radii[1]) + F.col("c2")).cast("int")
    bounds = coded.sparkSession.createDataFrame(
        [(c, int(starts[c]), int(sizes[c])) for c in np.flatnonzero(sizes).tolist()], "cell int, start bigint, n bigint")
    placed = coded.drop("r1", "r2").withColumn("cell", cell).join(F.broadcast(bounds), "cell")
    place: Column = F.col("start") + F.pmod(F.xxhash64("rid"), F.col("n"))
    placed = placed.withColumn("shard", F.floor(place / SHARD_ROWS).cast("bigint")).drop("cell", "start", "n")
    return placed, Layout(Books(books.half, books.words, radii), starts, sizes)


class Cells:
    """The rows of one shard by cell, for the multi-sequence search."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray):
        self.order = np.lexsort((c2, c1))
        self.first, self.second = np.unique(c1), np.unique(c2)
        pairs = c1[self.order].astype(np.int64) << 32 | c2[self.order]
        names, starts = np.unique(pairs, return_index=True)
        ends = [*starts[1:].tolist(), len(pairs)]
        self.at = {(int(p) >> 32, int(p) & 0xFFFFFFFF): (a, b) for p, a, b in zip(names, starts.tolist(), ends)}

    def visit(self, bounds1: np.ndarray, bounds2: np.ndarray):
        """Yields (positions of the rows of some cells, bound of all rows not yet yielded), best cells first."""
        one = self.first[np.argsort(-bounds1[self.first], kind="stable")].tolist()
        two = self.second[np.argsort(-bounds2[self.second], kind="stable")].tolist()
        b1, b2 = bounds1[one].tolist(), bounds2[two].tolist()
        heap, window, held, left = [(-b1[0] - b2[0], 0, 0)], [], 0, len(self.at)
        while heap and left:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-b1[i] - b2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-b1[i + 1] - b2[0], i + 1, 0))
            found = self.at.get((one[i], two[j]))
            if found:
                left -= 1
                window.append(self.order[found[0]:found[1]])
                held += found[1] - found[0]
            if window and (held >= WINDOW_ROWS or not left):
                yield np.concatenate(window), -heap[0][0] if heap and left else -np.inf
                window, held = [], 0
