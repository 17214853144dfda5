"""Language identification by a byte-level convolutional network, trained in numpy.

A text's bytes (ASCII letters in lower case) are cut into consecutive windows of ``WINDOW`` bytes, the last one padded
with zeros; all windows of the whole text are read.  Each byte is embedded, filters of several widths slide over the
window, the maximum of each filter goes through a softmax layer.  A document's probabilities are those of its windows,
weighted by their bytes.

Training takes a bounded sample: about ``TRAIN_DOCS`` documents of each label, ``TRAIN_CHARS`` code points of each.
Labels are never read at prediction.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, and so is every text when there was
nothing to learn from; repeated rows are kept; a NULL doc_id is not held out and not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fresh
from .training import held_out, sample

WINDOW = 256
WIDTHS = (2, 3, 4)  # the widest is even
FILTERS = 10  # of each width
DIMS = 8
TRAIN_DOCS = 500
TRAIN_CHARS = 2048
EPOCHS, MAX_EPOCHS, MIN_STEPS = 5, 60, 300
BATCH = 64
UNKNOWN = "und"
_STEP_BYTES = 1 << 20
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # max(WIDTHS) * DIMS x all filters; zero past a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: bytes) -> np.ndarray:
    """The windows of a text, one a row; one for an empty text."""
    data = text.translate(_LOWER)
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _columns(embedded: np.ndarray) -> np.ndarray:
    """(windows, positions, width * dims) from (windows, bytes, dims)."""
    widest = max(WIDTHS)
    n = embedded.shape[1] - widest + 1
    return np.concatenate([embedded[:, k:k + n] for k in range(widest)], axis=2)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pair_tables(model: Model) -> list[np.ndarray]:
    """What two bytes in a row add to every filter, for the first two and the next two places of a filter."""
    place = [model.embed @ model.filters[k * DIMS:(k + 1) * DIMS] for k in range(max(WIDTHS))]
    return [(a[:, None] + b[None]).reshape(1 << 16, -1) for a, b in zip(place[::2], place[1::2])]


def probabilities(model: Model, tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class probabilities of each window; the convolution is a sum of pair-table rows, position by position."""
    n = WINDOW - max(WIDTHS) + 1
    parts = []
    for i in range(0, len(x), 128):
        by_place = np.ascontiguousarray(x[i:i + 128].T).astype(np.uint16)
        pairs = by_place[:-1] << 8 | by_place[1:]
        maps = sum(np.take(t, pairs[2 * k:2 * k + n], axis=0) for k, t in enumerate(tables))
        pooled = np.maximum(maps.max(axis=0) + model.bias, 0)
        parts.append(_softmax(pooled @ model.out + model.out_bias))
    return np.concatenate(parts)


def train(pairs: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Adam on the cross-entropy of single windows; None without examples."""
    labels = sorted({label for _, label in pairs})
    if not labels:
        return None
    x, y = [], []
    for text, label in pairs:
        part = windows(text.encode())
        x.append(part)
        y += [labels.index(label)] * len(part)
    x, y = np.concatenate(x), np.array(y)
    rng = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    open_ = np.zeros((widest, DIMS, n_filters), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        open_[:width, :, i * FILTERS:(i + 1) * FILTERS] = 1
    open_ = open_.reshape(widest * DIMS, n_filters)
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    p = {"embed": normal(256, DIMS) * 0.5, "filters": normal(widest * DIMS, n_filters) * 0.25 * open_,
         "bias": np.zeros(n_filters, np.float32), "out": normal(n_filters, len(labels)) * 0.2,
         "out_bias": np.zeros(len(labels), np.float32)}
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    var = {k: np.zeros_like(v) for k, v in p.items()}
    epochs, step = min(MAX_EPOCHS, max(EPOCHS, MIN_STEPS * BATCH // len(x))), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            xb, yb = x[order[i:i + BATCH]], y[order[i:i + BATCH]]
            columns = _columns(p["embed"][xb])
            maps = columns @ p["filters"]
            at = maps.argmax(axis=1)
            rows = np.arange(len(xb))[:, None]
            pooled = np.maximum(np.take_along_axis(maps, at[:, None], axis=1)[:, 0] + p["bias"], 0)
            error = _softmax(pooled @ p["out"] + p["out_bias"])
            error[np.arange(len(xb)), yb] -= 1
            error /= len(xb)
            back = (error @ p["out"].T) * (pooled > 0)
            picked = columns[rows, at]  # windows x filters x width * dims
            g = {"out": pooled.T @ error, "out_bias": error.sum(0), "bias": back.sum(0),
                 "filters": np.einsum("nf,nfd->df", back, picked) * open_, "embed": np.zeros_like(p["embed"])}
            into = back[:, :, None] * p["filters"].T  # windows x filters x width * dims
            for k in range(widest):
                np.add.at(g["embed"], xb[rows, at + k], into[:, :, k * DIMS:(k + 1) * DIMS])
            step += 1
            for k, v in p.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                var[k] += 0.01 * (g[k] ** 2 - var[k])
                v -= 0.005 * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-7)
    return Model(labels, **p)


def fit(docs: DataFrame) -> Model | None:
    """A model of ``lang`` learned from the rows outside the held-out fold."""
    return train(sample(docs.select("doc_id", "text", F.col("lang").cast("string").alias("label")),
                        TRAIN_DOCS, TRAIN_CHARS))


def _predictor(parts: dict, text: str, out: str, schema: T.StructType):
    def predict(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field(out).type
        model = Model(**parts)
        tables = pair_tables(model)
        for batch in batches:
            for block in blocks(batch, text, _STEP_BYTES):
                texts = [t or b"" for t in block.column(text).to_pylist()]
                x = [windows(t) for t in texts]
                first = np.cumsum([0] + [len(w) for w in x])
                sizes = np.concatenate([np.r_[np.full(len(w) - 1, WINDOW), len(t) - WINDOW * (len(w) - 1)]
                                        for t, w in zip(texts, x)]).astype(np.float64) + 1e-9
                weighted = probabilities(model, tables, np.concatenate(x)).astype(np.float64) * sizes[:, None]
                each = np.add.reduceat(weighted, first[:-1]) / np.add.reduceat(sizes, first[:-1])[:, None]
                best = each.argmax(axis=1)
                rows = [{"lang": model.labels[b], "score": float(min(1.0, each[i, b]))} for i, b in enumerate(best)]
                at = block.schema.get_field_index(out)
                yield block.set_column(at, pa.field(out, kind), pa.array(rows, type=kind))

    return predict


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, out: str = "language") -> DataFrame:
    """``docs`` with the struct ``out``: lang and score."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return docs.withColumn(out, unknown)
    text = fresh(docs, "scanned")
    asked = docs.withColumn(text, F.col("text").cast("binary")).withColumn(out, unknown)
    found = asked.mapInArrow(_predictor(vars(model), text, out, asked.schema), asked.schema).drop(text)
    return found.withColumn(out, F.when(_lettered(), F.col(out)).otherwise(unknown))


def report(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), fit(docs), "language")
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"))


def keep_known(docs: DataFrame, min_score: float) -> DataFrame:
    """``docs`` without the documents of no known language (``und``, or a score below ``min_score``).

    A document without ``lang`` gets the predicted one.  Where there was nothing to learn from, only texts without a
    letter go, and no language is filled in.
    """
    out = fresh(docs, "language")
    model = fit(docs)
    if model is None:
        return docs.where(_lettered())
    found = predict(docs, model, out)
    found = found.where((F.col(out)["lang"] != UNKNOWN) & (F.col(out)["score"] >= min_score))
    lang = F.coalesce(F.col("lang"), F.col(out)["lang"].cast(docs.schema["lang"].dataType))
    return found.withColumn("lang", lang).drop(out)
