"""Hard-negative mining: exact searches of an inverted multi-index, certified by the bounds of its cells.

For every anchor the best rows of its own label are its positives; for every positive the best rows of another label
whose score lies in a window below the positive's are its hard negatives.  A score is the inner product of integer
vectors, so it is exact.

Both are searches for the best rows inside score windows.  A query goes to the shards with a cell whose bound (the sum
of its half-space bounds, radii included) reaches the least score that may still count, and visits the cells of a shard
in descending order of bound by a multi-sequence heap.  It ends there once its windows are certified: each is below the
bound of nothing left, because it is full with better scores or lies above that bound.  So no row is missed, whatever
the codebooks; on vectors without clusters the bounds are weak, and most cells are visited.

The search for positives runs twice: in the shard of the best cell alone, whose last positive then bounds the search
of the others.  Queries meet a shard in blocks of QUERY_BLOCK at most (on average), so neither side of a task grows.

Defined cases: rows with a NULL vec_id, label or vector, with a NULL or non-finite component, or whose integer vector
has a squared length of 2^62 or more (their scores are no bigints) take no part; missing components of shorter vectors
count as zero; repeated rows are rows of their own, and an anchor that comes twice is two anchors; a positive of
negative score has an empty window; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .multi_index import Books, Cells, Layout, build
from .vectors import dense, stacked

SCALE = 256
QUERY_BLOCK = 2048
#: Below any score and above any score.
LEAST, MOST = -(1 << 62), 1 << 62
#: Products up to here are exact in double precision.
_EXACT = float(1 << 53)


def _integers(batches):
    import pyarrow as pa

    for batch in batches:
        rows, vectors = dense(batch.column("embedding"))
        with np.errstate(over="ignore"):
            scaled = [np.floor(SCALE * v) for v in vectors]
            fits = [bool((s * s).sum() < MOST) for s in scaled]
        kept = pa.array(rows[np.array(fits, dtype=bool)])
        blobs = [s.astype("<i4").tobytes() for s, ok in zip(scaled, fits) if ok]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n).take(kept) for n in ("vec_id", "label", "anchor")], pa.array(blobs, type=pa.binary())],
            names=["vec_id", "label", "anchor", "v"])


def integer_vectors(rows: DataFrame) -> DataFrame:
    """rid, vec_id, label, anchor and v (int32 of the scaled components) of the rows that take part, written once."""
    usable = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "anchor", "embedding").where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    found = usable.mapInArrow(_integers, "vec_id bigint, label bigint, anchor boolean, v binary")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()))


def _shards(layout: Layout, home: bool):
    """Sends every query to the shards that may hold rows at its least low, or to its best one only."""
    def run(batches):
        import pyarrow as pa

        filled = layout.sizes > 0
        for batch in batches:
            q = stacked(batch.column("v").to_pylist(), "<i4", layout.books.width).astype(np.float64)
            first, second = layout.books.bounds(q)
            for k, lows in enumerate(batch.column("lows").to_pylist()):
                bound = np.where(filled, (first[k][:, None] + second[k][None, :]).ravel(), -np.inf)
                shards = layout.shards_of(np.array([bound.argmax()]) if home else np.flatnonzero(bound >= min(lows)))
                shards = shards[:1] if home else shards
                one = batch.slice(k, 1).take(pa.array(np.zeros(len(shards), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(shards.astype(np.int64))],
                                                 names=[*one.schema.names, "shard"])
    return run


class _Best:
    """The ``wanted`` best (score, least id) inside each window of a query."""

    def __init__(self, lows: list[int], highs: list[int], wanted: int):
        self.lows, self.highs, self.wanted = lows, highs, wanted
        self.floors = list(lows)
        self.found: list[list[tuple[int, int]]] = [[] for _ in lows]

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        for w, (floor, high) in enumerate(zip(self.floors, self.highs)):
            at = np.flatnonzero((scores >= floor) & (scores <= high))
            if len(at) > self.wanted:
                at = at[np.lexsort((names[at], -scores[at]))[:self.wanted]]
            if len(at):
                more = zip((-scores[at]).tolist(), names[at].tolist())
                self.found[w] = sorted([*self.found[w], *more])[:self.wanted]
                if len(self.found[w]) == self.wanted:
                    self.floors[w] = max(self.lows[w], -self.found[w][-1][0])

    def certified(self, bound: float) -> bool:
        return bound < min(self.floors)


def _probe(books: Books, same: bool, wanted: int):
    def run(rows, queries):
        import pyarrow as pa

        out: list[tuple[int, int, int, int]] = []
        if rows.num_rows and queries.num_rows:
            x = stacked(rows["v"].to_pylist(), "<i4", books.width)
            q = stacked(queries["v"].to_pylist(), "<i4", x.shape[1])
            if q.shape[1] > x.shape[1]:
                x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
            doubles = q.astype(np.float64)
            first, second = books.bounds(doubles)
            squares = [float((m.astype(np.float64) ** 2).sum(axis=1).max()) for m in (x, q)]
            kind = np.float64 if squares[0] * squares[1] < _EXACT ** 2 else np.int64
            x, q = x.astype(kind), q.astype(kind)
            rid, names, labels = (rows[c].to_numpy() for c in ("rid", "vec_id", "label"))
            cells = Cells(rows["c1"].to_numpy(), rows["c2"].to_numpy())
            asked = zip(*(queries[c].to_pylist() for c in ("qid", "label", "lows", "highs")))
            for k, (qid, label, lows, highs) in enumerate(asked):
                best = _Best(lows, highs, wanted)
                for at, left in cells.visit(first[k], second[k]):
                    may = at[((labels[at] == label) == same) & (rid[at] != qid)]
                    best.add((x[may] @ q[k]).astype(np.int64), names[may])
                    if best.certified(left):
                        break
                out += [(qid, w, name, -score) for w, found in enumerate(best.found) for score, name in found]
        columns = zip(*out) if out else [[]] * 4
        return pa.table({n: pa.array(c, type=pa.int64()) for n, c in zip(("qid", "window", "found", "score"), columns)})
    return run


def search(rows: DataFrame, layout: Layout, queries: DataFrame, blocks: int, same: bool, wanted: int,
           home: bool = False) -> DataFrame:
    """qid, window, rank, found (a vec_id) and score: the ``wanted`` best rows in each window of every query.

    ``queries`` has qid (the rid of its own row, which it does not find), label, v and the arrays lows and highs.
    ``same`` asks for rows of the query's label, else for those of the others.
    """
    sent = queries.select("qid", "label", "v", "lows", "highs")
    schema = "qid bigint, label bigint, v binary, lows array<bigint>, highs array<bigint>, shard bigint"
    sent = sent.mapInArrow(_shards(layout, home), schema).withColumn(
        "block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = rows.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(
        _probe(layout.books, same, wanted), "qid bigint, window bigint, found bigint, score bigint")
    order = Window.partitionBy("qid", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _least(score: Column, low: int, high: int) -> Column:
    """The least s with ``low * score <= high * s``, for scores of zero or more, without overflow."""
    return F.expr(f"score div {high} * {low} + (score % {high} * {low} + {high - 1}) div {high}")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, embedding) whose boolean ``anchor`` is true.

    anchor_id, positive_id, positive_rank, rank, negative_id, positive_score and negative_score: for each of an
    anchor's ``positives`` best rows of its label the ``negatives`` best ones of other labels whose score is at least
    ``low / high`` of the positive's and at most the positive's.  Ties go to the smaller vec_id.
    """
    vectors = integer_vectors(rows)
    index, layout = build(vectors.select("rid", "vec_id", "label", "v"))
    anchors = vectors.where("anchor").select(F.col("rid").alias("qid"), F.col("vec_id").alias("anchor_id"), "label", "v")
    blocks = -(-anchors.count() // QUERY_BLOCK) or 1

    def ranged(lows: Column, highs: Column) -> list[Column]:
        return [F.array(lows).alias("lows"), F.array(highs).alias("highs")]

    wide = anchors.select("*", *ranged(F.lit(LEAST), F.lit(MOST)))
    home = search(index, layout, wide, blocks, True, positives, home=True)
    last = home.where(F.col("rank") == positives).select("qid", F.col("score").alias("last"))
    narrow = anchors.join(last, "qid", "left").select(
        anchors["*"], *ranged(F.coalesce("last", F.lit(LEAST)), F.lit(MOST)))
    best = materialise(search(index, layout, narrow, blocks, True, positives))

    windows = best.where("score >= 0").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").alias("rank"), F.col("found").alias("found"), F.col("score").alias("high"),
        _least(F.col("score"), low, high).alias("low")))).alias("windows"))
    asked = materialise(anchors.join(windows, "qid").select(
        "*", F.col("windows.low").alias("lows"), F.col("windows.high").alias("highs")))
    negative = search(index, layout, asked, blocks, False, negatives).withColumnsRenamed(
        {"found": "negative_id", "score": "negative_score"})
    kept = asked.select("qid", "anchor_id", F.posexplode("windows").alias("window", "positive"))
    return negative.join(kept, ["qid", "window"]).select(
        "anchor_id", F.col("positive.found").alias("positive_id"), F.col("positive.rank").alias("positive_rank"), "rank",
        "negative_id", F.col("positive.high").alias("positive_score"), "negative_score")


def report(rows: DataFrame) -> DataFrame:
    """The registered task: anchors are the ids divisible by 100; ids divisible by 7 get the next label of ten."""
    label = F.col("label").cast("bigint")
    shifted = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                          (F.col("vec_id") % 100 == 0).alias("anchor"), "embedding")
    return mine(shifted).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
