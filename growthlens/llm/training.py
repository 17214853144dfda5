"""Bounded, deterministic samples of labelled rows to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sample has at most about this many rows in all, shared evenly by the labels; every label is learned as long as
#: there are no more labels than rows.
MAX_ROWS = 32_768
_GRAIN = 1 << 20


def fold() -> Column:
    """crc32 of doc_id as text, mod 3; NULL for a NULL doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def held_out() -> Column:
    return F.coalesce(fold() == 1, F.lit(False))


def _picked(rows: DataFrame, per_label: int) -> tuple[DataFrame, int]:
    """About ``per_label`` rows (of those with doc_id and label) a label, by a hash of doc_id; a bound of their number.

    Where there are very many labels, fewer of each: their sum is bounded by about MAX_ROWS.
    """
    rows = rows.where((fold() != 1) & F.col("label").isNotNull())
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MAX_ROWS).collect()
    per_label = min(per_label, max(1, MAX_ROWS // max(1, len(counts))))
    shares = {r.label: min(_GRAIN, 1 + per_label * _GRAIN // r.n) for r in counts}
    if not shares:
        return rows.limit(0), 0
    limits = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    grain = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_GRAIN))
    return (rows.where(F.col("label").isin(list(shares)) & (grain < limits[F.col("label")])),
            2 * per_label * len(shares))


def _passages(rows: DataFrame, bound: int, max_chars: int) -> list[tuple[str, str]]:
    start = F.greatest(F.lit(1), ((F.length("text") - max_chars) / 2).cast("int"))
    rows = rows.where(F.length("text") > 0).select("label", "doc_id", F.substr("text", start, F.lit(max_chars)).alias("text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(bound)
    return [(r.text, r.label) for r in rows.collect()]


def sample(rows: DataFrame, per_label: int, max_chars: int) -> list[tuple[str, str]]:
    """About ``per_label`` (text, label) pairs a label, at most ``2 * per_label * labels`` in all.

    ``rows`` has doc_id, text and a string label; rows with a NULL in any of them, without text, or of the held-out
    fold are left out.  Texts longer than ``max_chars`` give a passage of that length from their middle.  The rows
    are picked by a hash of doc_id, so the sample is the same on every run.
    """
    picked, bound = _picked(rows.where(F.length("text") > 0), per_label)
    return _passages(picked, bound, max_chars)


def sample_by_id(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int) -> list[tuple[str, str]]:
    """As ``sample``, for labels (doc_id, label; one row a doc_id) that lie apart from the texts.

    The labels are picked first; the bounded list is broadcast, so that no text is shuffled.
    """
    picked, bound = _picked(labels.select("doc_id", "label"), per_label)
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return _passages(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), bound, max_chars)
