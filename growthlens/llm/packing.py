"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Tokenising emits one narrow row per piece; texts are not shuffled.  Pieces are dealt by hash into groups of about
``GROUP_PIECES`` (repeated rows by their number, so equal rows spread) and each group is packed in a task of its own:
best fit, longest first, then exchanges between underfull sequences.  The least filled sequence gives items to others:
by moving one, by swapping one for a smaller one, two for one or one for two.  Every exchange raises the sum of
squared fills, so the search ends: at the lower bound of the number of sequences, or where no two sequences have an
exchange left.  The lengths and the sums of two in a sequence are bit sets, united over the sequences of equal free
space, so neither the number of items nor of sequences needs a bound.

Tokenising remembers words: a text is split at white space and the ids of a chunk are looked up, as this tokenizer's
normaliser and pre-tokenizer never join chunks; new chunks go to its model.

Defined cases: NULL and empty texts are the single end token; repeated rows are packed each; a doc_id may be NULL.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialise

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 20_000
_MAX_CACHED = 600_000
_SCAN_BYTES = 8 << 20
_LETTERS = "a-zà-öø-ÿā-įı-ɏ"
_PLAIN_LETTERS = re.compile(f"[{_LETTERS}]+")
_PLAIN = re.compile(rf"[!-;=-~{_LETTERS}]+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free one from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids (in the machine's byte order, little-endian) of a lower-case run of letters or digits or marks, as the pre-tokenizer cuts them."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _letters(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self._word(word)
        return found

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if _PLAIN_LETTERS.fullmatch(low):
            return self._letters(low)
        if chunk[-1] in ".,;:!?" and _PLAIN_LETTERS.fullmatch(low[:-1]):
            return self._letters(low[:-1]) + self._letters(chunk[-1])
        if not _PLAIN.fullmatch(low):  # anything unusual, special tokens too
            return self._library(chunk)
        return b"".join([self._letters(word) for word in _WORDS.findall(low)])

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):  # white space to Python, not to the tokenizer
            return self._library(text)
        chunks = text.split()
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            for c in chunks:
                if c not in known:
                    known[c] = self._chunk(c)
            ids = b"".join([known[c] for c in chunks])
            if len(known) > _MAX_CACHED:  # the older half goes
                self.known = dict(islice(known.items(), len(known) // 2, None))
            return ids


def _tokeniser(shared):
    def tokenise(batches):
        import pyarrow as pa

        state = shared.value  # lives as long as the worker, so later tasks find the words that earlier ones met
        if "encoder" not in state:
            state["encoder"] = Encoder(state["json"])
        encoder, end = state["encoder"], np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for block in blocks(batch, "text", _SCAN_BYTES):
                owner, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(block.column("text").to_pylist()):
                    data = (encoder.ids(text.decode("utf-8", "replace")) if text else b"") + end
                    for k, at in enumerate(range(0, len(data), 4 * CAPACITY)):
                        part = data[at:at + 4 * CAPACITY]
                        owner.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                ids = block.column("doc_id").take(pa.array(owner, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return tokenise


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"json": f.read()})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_tokeniser(shared),
                           "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Items (by length) in bins, with the free space of each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.lengths = capacity, lengths
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        there = 0  # bit f: some bin has f free
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            need = self.lengths[i]
            fits = there >> need
            if fits:
                space = (fits & -fits).bit_length() - 1 + need
                b = by_free[space].pop()
                if not by_free[space]:
                    there &= ~(1 << space)
            else:
                b = len(self.items)
                self.items.append([])
                self.free.append(self.capacity)
            self.items[b].append(i)
            self.free[b] -= need
            by_free[self.free[b]].append(b)
            there |= 1 << self.free[b]

    def exchange(self, a: int, out: tuple, b: int, back: tuple) -> None:
        for i in out:
            self.items[a].remove(i)
        for i in back:
            self.items[b].remove(i)
        self.items[a] += back
        self.items[b] += out
        gained = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
        self.free[a] += gained
        self.free[b] -= gained

    def fewest(self) -> int:
        """A lower bound of the bins: by the sum, and as a bin holds at most k items longer than 1/(k+1) of it."""
        by_size = [-(-sum(n * (k + 1) > self.capacity for n in self.lengths) // k) for k in (1, 2, 3)]
        return max(-(-sum(self.lengths) // self.capacity), *by_size)

    def improve(self) -> None:
        """Exchanges until the lower bound is met or no two bins have one that raises the sum of squared fills."""
        used, least = len(self.items), self.fewest()
        if used <= least:
            return
        open_ = OpenBins(self)
        changed = True
        while changed:
            changed = False
            heap = [(-self.free[b], b) for b, items in enumerate(self.items) if items and self.free[b]]
            heapify(heap)
            while heap:
                space, a = heappop(heap)
                if not self.items[a] or self.free[a] != -space:
                    continue
                chosen = open_.best(a)
                if chosen is None:
                    continue
                out, b, back = chosen
                open_.remove(a)
                open_.remove(b)
                self.exchange(a, out, b, back)
                changed = True
                if self.items[a]:
                    open_.add(a)
                    heappush(heap, (-self.free[a], a))
                else:
                    used -= 1
                    if used <= least:
                        return
                if self.free[b]:
                    open_.add(b)
                    heappush(heap, (-self.free[b], b))


def _bits(mask: int) -> list[int]:
    found = []
    while mask:
        low = mask & -mask
        found.append(low.bit_length() - 1)
        mask ^= low
    return found


class Shape:
    """The item lengths of a bin as bit sets: single lengths, sums of two, and what an exchange can give back."""

    def __init__(self, sizes: tuple[int, ...], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        counts = Counter(sizes)
        self.singles = self.pairs = 0
        for x in counts:
            self.singles |= 1 << x
        for x, n in counts.items():
            self.pairs |= (self.singles if n > 1 else self.singles & ~(1 << x)) << x
        # bit capacity - y: y comes back for one item (nothing, one or two), or for two (one)
        self.for_one = sum(1 << capacity - y for y in _bits(self.singles | self.pairs | 1))
        self.for_two = sum(1 << capacity - y for y in counts)
        self.one_out, self.two_out = _bits(self.singles), _bits(self.pairs)

    def gains(self, for_one: int, for_two: int) -> int:
        """Bit m: this shape can give m more than it gets back from bins with these sets."""
        top, found = self.capacity, 0
        for x in self.one_out:
            found |= for_one >> top - x
        if for_two.bit_count() < len(self.two_out):
            for at in _bits(for_two):
                found |= self.pairs >> top - at
        else:
            for x in self.two_out:
                found |= for_two >> top - x
        return found


class OpenBins:
    """The bins with free space, by it; bins of equal item lengths share a shape.

    A search asks one union of bit sets for each amount of free space, not each bin.  A shape that was searched in
    vain is searched again only among the amounts that bins have come to since.
    """

    def __init__(self, bins: Bins):
        self.bins, self.clock = bins, 0
        self.shapes: dict[tuple, Shape] = {}
        self.shape: dict[int, Shape] = {}
        self.by_free: dict[int, dict[Shape, dict[int, None]]] = {}
        self.unions: dict[int, tuple[int, int]] = {}
        self.came: dict[int, int] = {}
        self.tried: dict[Shape, int] = {}
        for b, items in enumerate(bins.items):
            if items and bins.free[b]:
                self.add(b)

    def add(self, b: int) -> None:
        sizes = tuple(sorted(self.bins.lengths[i] for i in self.bins.items[b]))
        shape = self.shapes.get(sizes)
        if shape is None:
            shape = self.shapes[sizes] = Shape(sizes, self.bins.capacity)
        free = self.bins.free[b]
        self.shape[b] = shape
        self.by_free.setdefault(free, {}).setdefault(shape, {})[b] = None
        if free in self.unions:
            one, two = self.unions[free]
            self.unions[free] = one | shape.for_one, two | shape.for_two
        self.clock += 1
        self.came[free] = self.clock

    def remove(self, b: int) -> None:
        shape, free = self.shape.pop(b), self.bins.free[b]
        there = self.by_free[free]
        del there[shape][b]
        if not there[shape]:
            del there[shape]
            self.unions.pop(free, None)
            if not there:
                del self.by_free[free]

    def _union(self, free: int, a: int) -> tuple[int, int]:
        """What bins with ``free`` left, except ``a``, can give back."""
        own = self.shape[a] if free == self.bins.free[a] else None
        alone = own is not None and len(self.by_free[free][own]) == 1
        if not alone and free in self.unions:
            return self.unions[free]
        one = two = 0
        for shape in self.by_free[free]:
            if not alone or shape is not own:
                one |= shape.for_one
                two |= shape.for_two
        if not alone:
            self.unions[free] = one, two
        return one, two

    def best(self, a: int):
        """The exchange from bin ``a`` that raises the sum of squared fills most, or None: (out, b, back)."""
        mine, space = self.shape[a], self.bins.free[a]
        since = self.tried.get(mine, 0)
        best, at = 0, None
        for free in sorted(self.by_free, reverse=True):
            if 2 * free * space <= best:  # no more than ``free`` can move
                break
            if self.came[free] <= since:
                continue
            # the most that moves is best: (fb + m)^2 + (fa - m)^2 - fb^2 - fa^2 = 2 m (m + space - free)
            more = (mine.gains(*self._union(free, a)) & (2 << free) - 2).bit_length() - 1
            if more > 0 and 2 * more * (more + space - free) > best:
                best, at = 2 * more * (more + space - free), (free, more)
        if at is None:
            self.tried[mine] = self.clock
            return None
        free, more = at
        for shape, there in self.by_free[free].items():
            b = next((b for b in there if b != a), None)
            if b is not None and mine.gains(shape.for_one, shape.for_two) >> more & 1:
                return self._items(a, b, more)

    def _items(self, a: int, b: int, more: int):
        """Items of ``a`` and ``b`` whose exchange moves ``more``."""
        size = self.bins.lengths
        mine = {size[i]: i for i in self.bins.items[a]}
        theirs = {size[i]: i for i in self.bins.items[b]}

        def pair(items: list[int], total: int):
            seen: dict[int, int] = {}
            for i in items:
                j = seen.get(total - size[i])
                if j is not None:
                    return j, i
                seen[size[i]] = i
            return None

        for x, i in mine.items():
            if x == more:
                return (i,), b, ()
            if x - more in theirs:
                return (i,), b, (theirs[x - more],)
        for x, i in mine.items():
            back = pair(self.bins.items[b], x - more)
            if back:
                return (i,), b, back
        for y, j in theirs.items():
            out = pair(self.bins.items[a], y + more)
            if out:
                return out, b, (j,)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of item numbers; items of the full capacity have bins of their own."""
    part = [i for i, n in enumerate(lengths) if n < capacity]
    bins = Bins([lengths[i] for i in part], capacity)
    bins.best_fit()
    bins.improve()
    return [[i] for i, n in enumerate(lengths) if n >= capacity] + [[part[i] for i in b] for b in bins.items if b]


def _pack_group(table):
    import pyarrow as pa

    lengths = table.column("length").to_pylist()
    group = table.column("group")[0].as_py()
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for k, items in enumerate(pack(lengths)):
        at = 0
        for i in items:
            sequence[i], offset[i] = (group << 32) + k, at
            at += lengths[i]
    return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
        "offset", pa.array(offset, pa.int64()))


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every piece with its sequence and its place there."""
    found = materialise(pieces(docs, tokenizer_path))
    groups = max(1, -(-found.count() // GROUP_PIECES))
    # equal rows are told apart by their place in the written table, so that they are dealt to all groups
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()),
                                             F.lit(groups)).cast("bigint"))
    dealt = dealt.groupBy("group").applyInArrow(
        _pack_group, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
                     "offset bigint")
    return dealt
