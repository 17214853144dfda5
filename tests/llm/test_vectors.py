"""Hard negatives and nearest neighbours against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.llm import ann, graph, hard_negatives, multi_index

from .helpers import SF

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])
BAD = [(None, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None, 3.0], 1), (300, [1.0, float("nan")], 2),
       (400, [float("inf"), 1.0], 2), (500, [1.0, 2.0, 3.0], None)]


def random_rows(n, size=16, seed=1, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, [float(np.float32(x)) for x in rng.normal(size=size) / 4], int(rng.integers(3))) for i in range(n)]


def with_clashes(df):
    for name in ("v", "rid", "shard", "block", "qid", "c1", "cell", "n", "anchor", "asks", "rank", "score", "node"):
        df = df.withColumn(name, F.lit("x"))
    return df


def usable(rows):
    return [(i, v, label) for i, v, label in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


# ---- hard negatives ------------------------------------------------------------------------------------------------

def plain_negatives(rows):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
            for i, v, label in usable(rows) if label is not None]
    kept = [r for r in kept if sum(x * x for x in r[1]) < 1 << 62]
    out = Counter()
    for k, (i, v, label) in enumerate(kept):
        if i % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, other == label)
                      for m, (j, w, other) in enumerate(kept) if m != k]
            for ps, pid in sorted((s, j) for s, j, same in scored if same)[:5]:
                fit = sorted((s, j) for s, j, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps)[:5]
                for rank, (s, j) in enumerate(fit, 1):
                    out[i, pid, rank, j, -ps, -s] += 1
    return out


def check_negatives(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(5))
    got = Counter(tuple(r) for r in hard_negatives.report(df).collect())
    want = plain_negatives(rows)
    assert got == want
    return got


def test_negatives_of_awkward_rows(spark):
    rows = random_rows(250) + BAD + random_rows(3, size=5, first=1000) + random_rows(3, size=33, first=1100)
    rows += [(1200, [], 1), (1300, [0.0] * 16, 1), (1400, [2.0e6] * 16, 1), (1401, [1.9e6] * 16, 2), (1500, [3e38] * 16, 1)]
    rows += [rows[0], rows[100], rows[100], rows[7]]
    assert check_negatives(spark, rows)


def test_negatives_with_ties_and_a_crowd(spark, monkeypatch):
    """A third of the rows is one vector; shards and blocks are small, so its cell is cut and queries come in blocks."""
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 40)
    monkeypatch.setattr(multi_index, "WINDOW_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "QUERY_BLOCK", 2)
    rows = random_rows(300)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(150)]
    assert check_negatives(spark, rows)


@pytest.mark.parametrize("rows", [[], BAD, [(100, [1.0, 2.0], 1)], [(100, [1.0], 1), (1, [2.0], 1), (2, [1.5], 2)]])
def test_negatives_of_few_rows(spark, rows):
    check_negatives(spark, rows)


def test_shards_are_even_and_every_row_is_in_its_cell(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 50)
    rows = random_rows(400) + [(1000 + i, [0.5] * 16, 1) for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("anchor", F.lit(False))
    placed, layout = multi_index.build(hard_negatives.integer_vectors(df).select("rid", "v"))
    shards = Counter(r.shard for r in placed.collect())
    assert sum(shards.values()) == 600 and max(shards.values()) <= 100 and len(shards) >= 12
    every = layout.shards_of(np.arange(len(layout.sizes)))
    assert set(shards) <= set(every.tolist())


def test_bounds_hold(spark):
    df = spark.createDataFrame(random_rows(300), VECTORS).withColumn("anchor", F.lit(False))
    placed, layout = multi_index.build(hard_negatives.integer_vectors(df).select("rid", "v"))
    rows = placed.collect()
    x = np.array([np.frombuffer(bytes(r.v), "<i4") for r in rows]).astype(float)
    first, second = layout.books.bounds(x[:20])
    c1, c2 = [r.c1 for r in rows], [r.c2 for r in rows]
    assert (x[:20] @ x.T <= first[:, c1] + second[:, c2]).all()


def test_the_heap_visits_cells_in_order_of_their_bound(monkeypatch):
    monkeypatch.setattr(multi_index, "WINDOW_ROWS", 1)
    rng = np.random.default_rng(3)
    c1, c2 = rng.integers(0, 6, 80).astype(np.int32), rng.integers(0, 6, 80).astype(np.int32)
    b1, b2 = rng.normal(size=6), rng.normal(size=6)
    seen, left = [], np.inf
    for rows, rest in multi_index.Cells(c1, c2).visit(b1, b2):
        bounds = b1[c1[rows]] + b2[c2[rows]]
        assert (bounds <= left + 1e-12).all() and (bounds >= rest - 1e-12).all()
        left = rest
        seen += rows.tolist()
    assert sorted(seen) == list(range(80)) and left == -np.inf


# ---- nearest neighbours --------------------------------------------------------------------------------------------

def plain_nearest(rows, k=5):
    kept = [r for r in usable(rows) if any(r[1])]
    if not kept:
        return {}
    width = max(len(v) for _, v, _ in kept)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v, _ in kept])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt((x ** 2).sum(axis=1))[:, None]
    names = np.array([i for i, _, _ in kept])
    out = {}
    for q in np.flatnonzero(names % 50 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((names, -s)) if j != q][:k]
        out.setdefault(int(names[q]), []).append([(int(names[j]), float(s[j])) for j in order])
    return out


def found(spark, rows, k=5):
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(5))
    out = {}
    for r in ann.report(df).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    hits = total = 0
    for q, lists in want.items():
        for nearest in lists:
            total += len(nearest)
            least = nearest[-1][1] - 1e-12 if nearest else 0
            hits += min(len(nearest), len({i for _, i, s in got.get(q, []) if s >= least}))
    return hits / max(total, 1)


def test_neighbours_of_awkward_rows(spark):
    rows = random_rows(400) + BAD + [(1000, [0.0] * 16, 1), (1050, [], 1), (1100, [3e38] * 16, 1), (1150, [1e-42] * 9, 2)]
    rows += random_rows(3, size=5, first=1200)
    got, want = found(spark, rows), plain_nearest(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    for q, lists in want.items():
        exact = dict(lists[0])
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in got[q] if i in exact)


@pytest.mark.parametrize("rows", [[], BAD, [(50, [1.0, 0.0], 1)], [(50, [1.0, 0.0], 1), (3, [1.0, 1.0], 1), (2, [2.0, 2.0], 1)]])
def test_neighbours_of_few_rows(spark, rows):
    got = {q: [i for _, i, _ in v] for q, v in found(spark, rows).items()}
    assert got == {q: [i for i, _ in v[0]] for q, v in plain_nearest(rows).items() if v[0]}


def test_copies_and_near_copies(spark, monkeypatch):
    """A third exact copies, a third near copies; ties go to the smaller id, and a query does not find itself."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = random_rows(400)
    rows += [(1000 + i, rows[3][1], 1) for i in range(400)]
    rows += [(2000 + i, [float(np.float32(x + y)) for x, y in zip(rows[5][1], rng.normal(size=16) / 200)], 1)
             for i in range(400)]
    got, want = found(spark, rows), plain_nearest(rows)
    assert recall(got, want) >= 0.9
    assert [i for _, i, _ in got[1000]] == [3, 1001, 1002, 1003, 1004]
    assert [i for _, i, _ in got[1350]] == [3, 1000, 1001, 1002, 1003]


def test_repeated_rows_find_each_other(spark):
    rows = random_rows(60) + [random_rows(60)[50]]
    got = found(spark, rows)
    assert got[50][0][1] == got[50][1][1] == 50 and len(got[50]) == 10


def test_recall_on_the_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert recall(found(spark, rows), plain_nearest(rows)) >= 0.97


def test_recall_of_a_full_shard():
    """One graph of 4,096 nodes, half of them near copies of one vector."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4096, 48))
    x[::2] = x[0] + rng.normal(size=(2048, 48)) / 50
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    edges, starts = graph.build(x)
    asked = x[5::64] + rng.normal(size=x[5::64].shape).astype(np.float32) / 20
    asked = (asked / np.linalg.norm(asked, axis=1)[:, None]).astype(np.float32)
    beams, _ = graph.beam_search(x, edges, starts, asked, ann.BEAM)
    best = np.argsort(-(asked @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a.tolist()) & set(b[:5].tolist())) / 5 for a, b in zip(best, beams)]) >= 0.9
    assert ((edges >= 0).sum(axis=1) <= graph.DEGREE).all() and not (edges == np.arange(4096)[:, None]).any()


def test_pruning_keeps_diverse_neighbours():
    angles = np.array([0.0, 0.1, 0.11, 0.12, -0.2, 1.0])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    kept = graph.prune(x, np.array([0]), np.array([[1, 2, 3, 4, 5, -1, 1, 0]], dtype=np.int32))[0]
    assert kept[kept >= 0].tolist() == [1, 4, 5]
