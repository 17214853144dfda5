"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from growthlens.llm import merkle

from .helpers import DOCS, SF, awkward, frame


def sha(s):
    return hashlib.sha256(s).hexdigest()


def plain_leaf(values):
    parts = [b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values]
    return sha(b"".join(parts))


def plain_tree(nodes, fanout):
    """The root and each leaf's path of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = nodes[at[k] // fanout * fanout:][:fanout]
            path.append(("".join(run[:at[k] % fanout]), "".join(run[at[k] % fanout + 1:])))
            at[k] //= fanout
        nodes = [sha("".join(nodes[i:i + fanout]).encode()) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_report(rows, fanout=8):
    groups = defaultdict(list)
    for r in rows:
        leaf = plain_leaf((r.doc_id, r.source, r.lang, r.n_chars, r.text))
        tampered = leaf
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            tampered = plain_leaf((r.doc_id, r.source, r.lang, r.n_chars, text))
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf, r.doc_id, tampered))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names]
    if not names:
        return Counter()
    root, tops = plain_tree([t[0] for t in trees], fanout)
    out = Counter()
    for g, (subroot, paths), top in zip(names, trees, tops):
        for (_, _, leaf, doc_id, own), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            proof = sha("".join(a + b for a, b in path + top).encode())
            for a, b in path + top:
                own = sha((a + own + b).encode())
            out[doc_id, leaf, subroot, root, proof, own, own == root] += 1
    return out


def check(df, fanout=8):
    got = Counter(tuple(r) for r in merkle.report(df, fanout).collect())
    assert got == plain_report(df.collect(), fanout)
    return got


def test_awkward_rows_and_clashing_columns(spark):
    df = awkward(spark)
    for name in ("tree", "idx", "n", "digest", "part", "twin", "before", "after", "tampered", "root"):
        df = df.withColumn(name, F.lit("x"))
    df = df.withColumn("lang", F.when(F.col("doc_id") == 0, "").when(F.col("doc_id") == 1, "ünï").otherwise(F.col("lang")))
    check(df)


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_the_whole_table(spark, fanout):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"), fanout)
    assert 0 < sum(n for row, n in got.items() if not row[-1]) < sum(got.values()) / 2


@pytest.mark.parametrize("count", [0, 1, 8, 9, 64, 65])
def test_edges_of_runs(spark, count):
    check(frame(spark, [f"Text {i}" for i in range(count)]))


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(7, "Same", "en", "s", 4)] * 300 + [(i, f"T{i}", "en", "s", 2) for i in range(40)]
    got = check(spark.createDataFrame(rows, DOCS).repartition(7))
    assert sum(got.values()) == 340


def test_many_groups_make_a_tree_of_their_own(spark):
    rows = [(i, f"Text {i}", f"l{i % 90}", "s", 6) for i in range(400)]
    check(spark.createDataFrame(rows, DOCS))


def test_a_changed_text_is_noticed(spark):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(30)]
    one = merkle.report(spark.createDataFrame(rows, DOCS)).first()
    other = merkle.report(spark.createDataFrame([*rows[:-1], (29, "text 29!", "en", "s", 6)], DOCS)).first()
    assert one.verified and one.root != other.root


def test_positions_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("a", i % 50, f"{i:03d}") for i in range(500)], "tree string, doc_id bigint, digest string")
    want = {(d, x): k for k, (d, x) in enumerate(sorted((i % 50, f"{i:03d}") for i in range(500)))}
    for parts in (1, 13):
        got = merkle.indexed(rows.repartition(parts), "doc_id", "digest").collect()
        assert {(r.doc_id, r.digest): r.idx for r in got} == want and {r.n for r in got} == {500}
