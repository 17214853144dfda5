"""Vector columns between Spark and numpy."""

from __future__ import annotations

import numpy as np


def dense(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of an Arrow list column: the positions of the usable rows, and their components in double precision.

    A row is usable if it is not NULL and has no NULL and no non-finite component.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.flatnonzero(lengths >= 0)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    parts = np.split(values, np.cumsum(lengths[there])[:-1]) if len(there) else []
    good = [bool(np.isfinite(p).all()) for p in parts]
    return there[good], [p for p, ok in zip(parts, good) if ok]


def stacked(blobs: list[bytes], kind: str, width: int = 0) -> np.ndarray:
    """The vectors as rows of a matrix with at least ``width`` columns; shorter ones are filled up with zeros."""
    size = np.dtype(kind).itemsize
    longest = max([len(b) // size for b in blobs], default=0)
    if blobs and longest >= width and all(len(b) == longest * size for b in blobs):
        return np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), longest)
    out = np.zeros((len(blobs), max(longest, width)), dtype=kind)
    for row, b in zip(out, blobs):
        row[:len(b) // size] = np.frombuffer(b, dtype=kind)
    return out
