"""Merkle manifest of a dataset: leaves, trees, membership proofs and their verification, by sibling self-joins.

A row's leaf is the digest of its fields.  The leaves of one group, in order, are the lowest level of that group's
tree; ``fanout`` consecutive nodes (a run; the last may be shorter) become the digest of their digests, up to one node.
The groups' roots, in the order of the groups, are the leaves of one more tree, whose root stands for the dataset.

Every level is one equijoin of the level with itself: a node asks for the computed indices of its siblings (XOR 1 in a
binary tree, the other slots of its run otherwise; its own index is asked too, which brings its digest along), and
gets their digests in slot order.  The row in slot zero, which then knows its whole run, emits the parent.  No join key
is met by more than ``fanout`` rows, so a group that holds all rows is as even as many groups.  Positions come from a
range partitioning, prefix sums of its counts and the offset inside a partition, never from one sort of a group.

A proof is the path of a leaf: for each level up to the dataset's root the digests before and after the own node in its
run.  Paths are put together from the root downwards, so that what all leaves below a node share travels once a node.

Defined cases: a NULL field is ``-``; the NULL group comes first, and leaves with a NULL id come first in their group;
rows of one id in a group are ordered by their digest, and equal rows are leaves of their own; a lone leaf is its own
root; a run of one becomes the digest of that one; an empty table has no leaves and gives no rows; other columns of the
table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
#: monotonically_increasing_id keeps the offset inside a partition in the lower 33 bits.
_OFFSET_BITS = 33


def encoded(*fields: Column) -> Column:
    """The fields one after another, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A non-null name of the group that sorts as the groups do: NULL first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, ...) with idx, the position in the tree by ``order``, and n, the size of the tree."""
    keys = ["tree", *order, "twin"]  # equal rows may be very many: they differ in ``twin``
    rows = rows.withColumn("twin", F.monotonically_increasing_id())
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("twin").withColumn(
        "at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", _OFFSET_BITS)))
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = materialise(counts.select("tree", "part", (before - F.col("rows") - F.col("first")).alias("shift"),
                                       F.sum("rows").over(tree).alias("n")))
    return placed.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop(
        "at", "part", "shift")


def _run(fanout: int) -> Column:
    """The index of a node's run, which is its parent's."""
    return F.expr(f"idx div {fanout}")


def sibling_indices(fanout: int) -> Column:
    """The own index and those of all possible siblings; the last run lacks some of them."""
    idx = F.col("idx")
    if fanout == 2:
        return F.array(idx, idx.bitwiseXOR(F.lit(1).cast("bigint")))
    slot = idx % fanout
    return F.array(*[idx - slot + (slot + k) % fanout for k in range(fanout)])


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """tree, idx, n and digest of the nodes, and the joined digests ``before`` and ``after`` each in its run."""
    asked = nodes.select("tree", "idx", "n", F.explode(sibling_indices(fanout)).alias("other"))
    found = asked.join(nodes.select("tree", F.col("idx").alias("other"), "digest"), ["tree", "other"])
    runs = found.groupBy("tree", "idx", "n").agg(F.sort_array(F.collect_list(F.struct("other", "digest"))).alias("run"))

    def joined(test) -> Column:
        return F.array_join(F.transform(F.filter("run", lambda x: test(x["other"])), lambda x: x["digest"]), "")

    idx = F.col("idx")
    return runs.select("tree", "idx", "n", joined(lambda o: o == idx).alias("digest"),
                       joined(lambda o: o < idx).alias("before"), joined(lambda o: o > idx).alias("after"))


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all trees of ``leaves`` (tree, idx, n, digest), lowest first; a tree ends where its n is 1."""
    widest = leaves.agg(F.max("n")).first()[0] or 0
    nodes, out = leaves.select("tree", "idx", "n", "digest"), []
    while widest > 1:
        top = nodes.where("n = 1").withColumns({"before": F.lit(""), "after": F.lit("")})
        nodes = materialise(with_siblings(nodes.where("n > 1"), fanout).unionByName(top))
        out.append(nodes)
        up = nodes.where((F.col("n") > 1) & (F.col("idx") % fanout == 0))
        nodes = up.select("tree", _run(fanout).alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                          digest(F.col("digest"), F.col("after")).alias("digest"))
        widest = -(-widest // fanout)
    out.append(materialise(nodes.withColumns({"before": F.lit(""), "after": F.lit("")})))
    return out


def tops(tree_levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the one node that each tree ends in."""
    out = None
    for level in tree_levels:
        here = level.where("n = 1").select("tree", "digest")
        out = here if out is None else out.unionByName(here)
    return out


def paths(tree_levels: list[DataFrame], above: DataFrame, fanout: int, known: DataFrame | None = None) -> DataFrame:
    """tree, idx, digest and path of the lowest level, with the other columns of ``above`` and ``known``.

    ``above`` (tree, path, ...) has what follows the root of each tree; a path is an array of (before, after).
    ``known`` (tree, idx, ...) has the columns of the lowest nodes; they join before the paths do, which are wide.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    below = None
    for k, level in reversed(list(enumerate(tree_levels))):
        kept = ["tree", "idx", "digest"]
        if k == 0 and known is not None:
            kept += [c for c in known.columns if c not in kept]
            level = level.join(known, ["tree", "idx"])
        here = level.where("n = 1").join(above, "tree").select(*kept, "path", *more)
        if below is not None:
            parents = below.select("tree", F.col("idx").alias("parent"), F.col("path").alias("rest"), *more)
            going = level.where("n > 1").withColumn("parent", _run(fanout)).join(parents, ["tree", "parent"])
            path = F.concat(F.array(F.struct("before", "after")), F.col("rest"))
            here = here.unionByName(going.select(*kept, path.alias("path"), *more))
        below = here
    return below


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the path of its siblings lead to."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["before"], own, step["after"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """The leaves (tree, idx, n, digest, doc_id, ...), the roots of the groups in their order (named, idx, digest),
    and the levels of the groups' trees and of the tree over their roots."""

    leaves: DataFrame
    roots: DataFrame
    groups: list[DataFrame]
    dataset: list[DataFrame]
    fanout: int

    def proofs(self, *columns: str) -> DataFrame:
        """digest, path to the dataset's root, subroot, root and the ``columns`` of every leaf."""
        nothing = F.array().cast("array<struct<before:string,after:string>>")
        root = tops(self.dataset).select("tree", nothing.alias("path"), F.col("digest").alias("root"))
        over = paths(self.dataset, root, self.fanout).select("idx", "path", F.col("digest").alias("subroot"), "root")
        named = self.roots.select(F.col("named").alias("tree"), "idx").join(over, "idx").drop("idx")
        found = paths(self.groups, named, self.fanout, self.leaves.select("tree", "idx", *columns))
        return found.select("digest", "path", "subroot", "root", *columns)


def build(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``leaves`` (tree, digest, doc_id, ...); within a tree they ascend by doc_id, then by digest."""
    leaves = materialise(indexed(leaves, "doc_id", "digest"))
    groups = levels(leaves, fanout)
    roots = tops(groups).select(F.lit("").alias("tree"), F.col("tree").alias("named"), "digest")
    roots = materialise(indexed(roots, "named"))
    return Manifest(leaves, roots, groups, levels(roots, fanout), fanout)


def report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaf, roots and proof digest of every document, and where its leaf leads after tampering with the text.

    Tampering lower-cases A-Z in the texts of the documents whose crc32 of the id is divisible by three; the others
    (those without an id too) keep their leaf.
    """
    fields = docs.select(*FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, digest(encoded(*[F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c)
                                               for c in FIELDS])))
    leaves = fields.select(group_key(F.col("lang")).alias("tree"), "doc_id",
                           digest(encoded(*[F.col(c) for c in FIELDS])).alias("digest"), tampered.alias("tampered"))
    return build(leaves, fanout).proofs("doc_id", "tampered").select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
docs AS (
  SELECT doc_id, lang, coalesce('1' || lang, '0') AS tree, source, n_chars, text,
         CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(
           list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 3 = 0 END AS chosen
  FROM documents, crc_table),
texts AS (
  SELECT *, CASE WHEN chosen THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            ELSE text END AS changed,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM docs),
digests AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered
  FROM texts),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n
  FROM digests),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT '' AS tree, 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT '', level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM over_nodes WHERE n > 1 GROUP BY level, idx // 8),
runs AS (
  SELECT tree, level, idx // 8 AS run, list(digest ORDER BY idx) AS digests
  FROM (SELECT * FROM nodes UNION ALL SELECT * FROM over_nodes) GROUP BY ALL),
climb AS (
  SELECT leaves.tree AS own, leaves.idx AS pos, leaves.tree, 0 AS level, leaves.idx, leaves.n, tampered AS folded,
         '' AS proof
  FROM leaves
  UNION ALL
  SELECT own, pos, c.tree, c.level + 1, c.idx // 8, (c.n + 7) // 8,
         sha256(array_to_string(digests[:c.idx % 8] || [folded] || digests[c.idx % 8 + 2:], '')),
         proof || array_to_string(digests[:c.idx % 8] || digests[c.idx % 8 + 2:], '')
  FROM climb c JOIN runs r ON c.tree = r.tree AND c.level = r.level AND c.idx // 8 = r.run WHERE c.n > 1),
climb_over AS (
  SELECT own, pos, 0 AS level, s.idx, s.n, folded, proof FROM climb c JOIN subroots s ON c.own = s.tree WHERE c.n = 1
  UNION ALL
  SELECT own, pos, c.level + 1, c.idx // 8, (c.n + 7) // 8,
         sha256(array_to_string(digests[:c.idx % 8] || [folded] || digests[c.idx % 8 + 2:], '')),
         proof || array_to_string(digests[:c.idx % 8] || digests[c.idx % 8 + 2:], '')
  FROM climb_over c JOIN runs r ON r.tree = '' AND c.level = r.level AND c.idx // 8 = r.run WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN (SELECT digest AS root FROM over_nodes WHERE n = 1) ON true
JOIN climb_over c ON c.own = leaves.tree AND c.pos = leaves.idx AND c.n = 1
"""
