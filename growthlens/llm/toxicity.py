"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offsets.

Only documents carry labels, so the words of a bounded training sample are labelled from them: a word in a toxic
document is marked if it is, or starts with, a unit (a word or a prefix) that is significantly more frequent in toxic
documents.  The sample has about TRAIN_DOCS documents of each label; of a text of more than TRAIN_CHARS code points the
middle TRAIN_CHARS are learned from, all of them, in consecutive sequences.  Near copies are thinned out of the sample
first.  The field has two states; a word's feature weights belong to the same units.  It is trained by gradient ascent
on the likelihood of the marked sequences.

A document is scored as a whole.  Forward-backward runs over all documents of a block at once, word by word; the
two-state messages are log-odds.  A logistic layer, fitted on the training sample, turns the expected number of toxic
words, their greatest marginal and their density into a score.  Words whose marginal exceeds ``SPAN_PROBABILITY`` make
the offending spans.

Defined cases: NULL and wordless texts get the score that the logistic layer gives to no toxic word; without labelled
toxic and clean rows every score is 0; repeated documents are kept; label rows count once per doc_id (the greatest
label) and those with a NULL are ignored; documents with a NULL doc_id are not held out and not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fold_words, fresh
from .training import held_out, sample_by_id

TRAIN_DOCS = 2500  # of each label
TRAIN_CHARS = 12_000
PREFIXES = range(3, 10)  # bytes of UTF-8
MAX_UNITS = 20_000
MIN_RATIO, MIN_SIGNIFICANCE = 4.0, 20.0
SEQUENCE_WORDS = 400  # training cuts a passage into consecutive sequences of this length
STEPS = 40
SPAN_PROBABILITY = 0.5
THRESHOLD = 0.7
_SCAN_BYTES = 16 << 20
_MAX_CACHED = 400_000
#: Training goes through the sample in parts of about this many words, and through its documents in blocks.
_PART_WORDS = 100_000
_BLOCK_DOCS = 500
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def units(word: bytes) -> list[bytes]:
    """A word's features: its prefixes, and itself behind a blank."""
    return [word[:k] for k in PREFIXES if k <= len(word)] + [b" " + word]


@dataclass
class Model:
    weights: dict[bytes, float]  # of the toxic state against the clean one
    bias: float
    transitions: np.ndarray  # [from, to]
    logistic: np.ndarray


class Emissions(dict):
    """word -> log-odds of the toxic state, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.prefixes = {u[:k]: 0.0 for u in model.weights if u[0] != 32 for k in PREFIXES if k <= len(u)}
        self.prefixes |= {u: w for u, w in model.weights.items() if u[0] != 32}
        self.words = {u[1:]: w for u, w in model.weights.items() if u[0] == 32}

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _MAX_CACHED:
            self.clear()
        value = self.model.bias + self.words.get(word, 0.0)
        for k in PREFIXES:
            weight = self.prefixes.get(word[:k])
            if weight is None or k > len(word):
                break
            value += weight
        self[word] = value
        return value


class Batch:
    """Sequences of different lengths, stepped through together, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), side="left")  # longer than t

    def messages(self, d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward log-odds (with the word's own) and backward log-odds (without it) of the toxic state."""
        forward, backward = d.copy(), np.zeros_like(d)
        for t in range(1, len(self.active)):
            at = self.starts[:self.active[t]] + t
            r = forward[at - 1]
            forward[at] += np.logaddexp(r + a[1, 1], a[0, 1]) - np.logaddexp(r + a[1, 0], a[0, 0])
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[:self.active[t]] + t
            r = backward[at] + d[at]
            backward[at - 1] = np.logaddexp(r + a[1, 1], a[1, 0]) - np.logaddexp(r + a[0, 1], a[0, 0])
        return forward, backward


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def marginals(lists: list[list[bytes]], emissions: Emissions) -> list[np.ndarray]:
    """Per document, each word's probability of the toxic state."""
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    d = np.fromiter(map(emissions.__getitem__, chain.from_iterable(lists)), dtype=np.float64, count=int(lengths.sum()))
    forward, backward = Batch(lengths).messages(d, emissions.model.transitions)
    return np.split(_sigmoid(forward + backward), np.cumsum(lengths)[:-1])


def document_features(p: list[np.ndarray]) -> np.ndarray:
    sums = np.array([x.sum() for x in p])
    tops = np.array([x.max() if len(x) else 0.0 for x in p])
    sizes = np.array([len(x) for x in p], dtype=np.float64)
    return np.stack([np.ones(len(p)), np.log1p(sums), tops, np.sqrt(100 * sums / (sizes + 20)), np.log1p(sizes) / 10], 1)


def _thinned(pairs: list[tuple[str, int]]) -> list[tuple[list[bytes], int]]:
    """Word lists without those that share a least five-word shingle with an earlier one."""
    seen, kept, known = set(), [], {}
    for text, label in pairs:
        words = [known.setdefault(w, w) for w in fold_words(text.encode())]  # one object a word, however often it comes
        if not words:
            continue
        key = min(crc32(b" ".join(s)) for s in zip(*(words[k:] for k in range(min(5, len(words))))))
        if key not in seen:
            seen.add(key)
            kept.append((words, label))
    return kept


def _telling(docs: list[tuple[list[bytes], int]]) -> tuple[set[bytes], list[bytes]]:
    """Units that mark toxic words, and all units worth a weight."""
    sizes = [sum(label == k for _, label in docs) for k in (0, 1)]
    counts = Counter(chain.from_iterable({u for w in set(words) for u in units(w)} for words, label in docs if label == 1))
    often = {u: n for u, n in counts.items() if n >= 3}
    del counts
    cleans = Counter(chain.from_iterable({u for w in set(words) for u in units(w) if u in often}
                                         for words, label in docs if label == 0))
    marking, scored = set(), []
    for unit, toxic in often.items():
        clean = cleans[unit]
        share = (toxic + 0.5) / (sizes[1] + 1), (clean + 0.5) / (sizes[0] + 1)
        both = (toxic + clean) / (sizes[0] + sizes[1])
        gain = 2 * toxic * np.log(toxic / (sizes[1] * both)) + (
            2 * clean * np.log(clean / (sizes[0] * both)) if clean else 0.0)
        if gain > MIN_SIGNIFICANCE / 4:
            scored.append((gain, unit))
        if share[0] > MIN_RATIO * share[1] and gain > MIN_SIGNIFICANCE:
            marking.add(unit)
    return marking, [u for _, u in sorted(scored, reverse=True)[:MAX_UNITS]]


def _parts(lengths: np.ndarray):
    """(first word, last word, batch, places of words that follow another) of runs of sequences of about _PART_WORDS."""
    ends = np.cumsum(lengths)
    for k in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(ends // _PART_WORDS)) + 1):
        batch = Batch(lengths[k])
        inner = np.ones(int(lengths[k].sum()), dtype=bool)
        inner[batch.starts[batch.lengths > 0]] = False
        yield int(ends[k[0]] - lengths[k[0]]), int(ends[k[-1]]), batch, np.flatnonzero(inner)


def train(pairs: list[tuple[str, int]]) -> Model | None:
    docs = _thinned(sorted(pairs))
    if len({label for _, label in docs}) < 2:
        return None
    marking, kept = _telling(docs)
    number = {u: i for i, u in enumerate(kept)}
    # consecutive sequences of words, marked words, and the units of each distinct word
    sequences = [(words[a:a + SEQUENCE_WORDS], label) for words, label in docs
                 for a in range(0, len(words), SEQUENCE_WORDS)]
    vocabulary: dict[bytes, int] = {}
    lengths = np.array([len(words) for words, _ in sequences], dtype=np.int64)
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for words, _ in sequences for w in words),
                      dtype=np.int32, count=int(lengths.sum()))
    marked = np.array([any(u in marking for u in units(w)) for w in vocabulary])
    y = np.repeat(np.array([label == 1 for _, label in sequences]), lengths) & marked[ids]
    owner = np.fromiter((i for i, w in enumerate(vocabulary) for u in units(w) if u in number), dtype=np.int32)
    unit = np.fromiter((number[u] for w in vocabulary for u in units(w) if u in number), dtype=np.int32)
    parts = list(_parts(lengths))
    weights, a = np.zeros(len(kept) + 1), np.zeros((2, 2))  # the last weight is the bias
    weights[-1] = -3.0
    mean, var = [np.zeros_like(weights), np.zeros_like(a)], [np.zeros_like(weights), np.zeros_like(a)]
    seen_pairs = sum(np.bincount(2 * y[first:last][inner - 1] + y[first:last][inner], minlength=4).reshape(2, 2)
                     for first, last, _, inner in parts)
    for step in range(1, STEPS + 1):
        word_score = np.bincount(owner, weights[unit], minlength=len(vocabulary)) + weights[-1]
        by_word, expected = np.zeros(len(vocabulary)), np.zeros((2, 2))
        for first, last, batch, inner in parts:
            mine = ids[first:last]
            d = word_score[mine]
            forward, backward = batch.messages(d, a)
            by_word += np.bincount(mine, y[first:last] - _sigmoid(forward + backward), minlength=len(vocabulary))
            joint = np.stack([np.zeros(len(inner)) + a[0, 0], d[inner] + backward[inner] + a[0, 1],
                              forward[inner - 1] + a[1, 0],
                              forward[inner - 1] + d[inner] + backward[inner] + a[1, 1]])
            joint = np.exp(joint - joint.max(axis=0))
            expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad_w = np.append(np.bincount(unit, by_word[owner], minlength=len(kept)), by_word.sum()) - 0.1 * weights
        for i, (value, grad) in enumerate(((weights, grad_w), (a, seen_pairs - expected - 0.1 * a))):
            mean[i] += 0.1 * (grad - mean[i])
            var[i] += 0.02 * (grad ** 2 - var[i])
            value += 0.25 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(var[i] / (1 - 0.98 ** step)) + 1e-8)
    model = Model({u: float(w) for u, w in zip(kept, weights) if abs(w) > 1e-3}, float(weights[-1]), a, np.zeros(5))
    emissions = Emissions(model)
    x = np.concatenate([document_features(marginals([words for words, _ in docs[i:i + _BLOCK_DOCS]], emissions))
                        for i in range(0, len(docs), _BLOCK_DOCS)])
    model.logistic = _logistic(x, np.array([label for _, label in docs], dtype=np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of ``labels.toxic`` learned from the rows outside the held-out fold."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("string").alias("label"))
    return train([(text, int(label)) for text, label in sample_by_id(docs, marks, TRAIN_DOCS, TRAIN_CHARS)])


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Code-point ranges of runs of toxic words."""
    flagged = p > SPAN_PROBABILITY
    if not flagged.any():
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flagged.astype(np.int8), [0]])))
    return [{"start": int(before[at[i][0]]), "end": int(before[at[j - 1][1]])} for i, j in zip(edges[::2], edges[1::2])]


def _scorer(parts: dict, text: str, out: str, schema: T.StructType):
    def score(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field(out).type
        model = Model(**parts)
        emissions = Emissions(model)
        for batch in batches:
            for block in blocks(batch, text, _SCAN_BYTES):
                texts = [t or b"" for t in block.column(text).to_pylist()]
                p = marginals([fold_words(t) for t in texts], emissions)
                scores = _sigmoid(document_features(p) @ model.logistic)
                rows = [{"score": float(s), "spans": _spans(t, q)} for s, t, q in zip(scores, texts, p)]
                at = block.schema.get_field_index(out)
                yield block.set_column(at, pa.field(out, kind), pa.array(rows, type=kind))

    return score


def score(docs: DataFrame, model: Model | None, out: str = "toxicity") -> DataFrame:
    """``docs`` with the struct ``out``: score and spans (start and end in code points)."""
    none = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))
    if model is None:
        return docs.withColumn(out, none)
    text = fresh(docs, "scanned")
    asked = docs.withColumn(text, F.col("text").cast("binary")).withColumn(out, none)
    return asked.mapInArrow(_scorer(vars(model), text, out, asked.schema), asked.schema).drop(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, class and offending spans (start:end in code points, comma-joined) of every document."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels), "t").drop("text")
    return found.select("doc_id", held_out().alias("held_out"), F.col("t.score").alias("score"),
                        (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"),
                        F.array_join(F.transform("t.spans", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",")
                        .alias("spans"))
