"""The two custom physical patterns against brute force."""

import random

from pyspark.sql import functions as F

from growthlens.plans.ntile import distributed_ntiles
from growthlens.plans.sessionize import sessionize


def _ntile_brute(values, n):
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    N = len(values)
    base, r = divmod(N, n)
    tiles = {}
    pos = 0
    for t in range(1, n + 1):
        size = base + (1 if t <= r else 0)
        for _ in range(size):
            tiles[order[pos]] = t
            pos += 1
    return tiles


def test_distributed_ntile_uneven_sizes_and_ties(spark):
    for N in (1, 4, 7, 11, 23, 200):
        rnd = random.Random(N)
        vals = [rnd.randint(0, 5) for _ in range(N)]  # heavy ties
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
        out = distributed_ntiles(df, "id", {"t": F.col("v")}, 5)
        got = {r.id: r.t for r in out.collect()}
        assert got == _ntile_brute(vals, 5), N


def test_several_scores_at_once_equal_one_by_one(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 6), rnd.randint(-3, 3), rnd.random(), "wide") for i in range(137)]
    df = spark.createDataFrame(rows, "id long, a long, b int, c double, w string")
    out = distributed_ntiles(df, "id", {"ta": F.col("a"), "tb": -F.col("b"), "tc": F.col("c")}, 5).collect()
    want = [_ntile_brute([r[1] for r in rows], 5), _ntile_brute([-r[2] for r in rows], 5),
            _ntile_brute([r[3] for r in rows], 5)]
    assert len(out) == len(rows)
    for r in out:
        assert (r.ta, r.tb, r.tc, r.w) == (want[0][r.id], want[1][r.id], want[2][r.id], "wide")


def test_distributed_ntile_descending(spark):
    vals = [3, 1, 2, 2, 5, 0, 9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    out = distributed_ntiles(df, "id", {"t": -F.col("v")}, 3)
    got = {r.id: r.t for r in out.collect()}
    exp = _ntile_brute([-v for v in vals], 3)
    assert got == exp


def _sessions_brute(events, gap):
    by_user = {}
    for u, t, e in events:
        by_user.setdefault(u, []).append((t, e))
    out = {}
    for u, evs in by_user.items():
        evs.sort()
        idx, prev = 0, None
        for t, e in evs:
            if prev is None or t - prev > gap:
                idx += 1
                out[e] = (idx, 1)
            else:
                out[e] = (idx, 0)
            prev = t
    return out


def test_bucketed_sessionize_matches_global_lag(spark):
    rnd = random.Random(7)
    events = []
    eid = 0
    for u in range(6):
        t = rnd.randint(0, 10_000)
        n = 400 if u == 0 else rnd.randint(1, 40)  # user 0 is the hot key
        for _ in range(n):
            t += rnd.choice([0, 0, 5, 60, 3599, 3600, 3601, 7200, 20_000])
            events.append((u, t, eid))
            eid += 1
    df = spark.createDataFrame(events, "u long, t long, e long")
    exp = _sessions_brute(events, 3600)
    for bucket in (1000, 3600, 86_400):
        out = sessionize(df, "u", "t", "e", gap_seconds=3600, bucket_seconds=bucket)
        got = {r.e: (r.session_idx, r.is_session_start) for r in out.collect()}
        assert got == exp, bucket
    # hot (user, bucket) cells split into fine buckets: same sessions
    for bucket, hot, fine in ((3600, 5, 60), (86_400, 20, 600), (3600, 1, 1)):
        out = sessionize(df, "u", "t", "e", gap_seconds=3600, bucket_seconds=bucket, hot_rows=hot, fine_seconds=fine)
        got = {r.e: (r.session_idx, r.is_session_start) for r in out.collect()}
        assert got == exp, (bucket, hot, fine)


def test_checkpoint_dir_comes_from_the_session_and_never_a_local_folder_on_a_cluster():
    import pytest

    from growthlens.plans.ntile import choose_checkpoint_dir

    assert choose_checkpoint_dir("/shared/ckpt/app-1", "/shared/ckpt", "yarn") == ("/shared/ckpt/app-1", False)
    assert choose_checkpoint_dir(None, "/shared/ckpt", "yarn") == ("/shared/ckpt", True)
    path, must_set = choose_checkpoint_dir(None, None, "local[8]")
    assert must_set and path.startswith("/")
    with pytest.raises(RuntimeError):
        choose_checkpoint_dir(None, None, "yarn")
    with pytest.raises(RuntimeError):
        choose_checkpoint_dir(None, None, "k8s://https://api:443")
