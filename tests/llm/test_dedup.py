"""SimHash components, repeated passages and benchmark windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from growthlens.llm import components, decontaminate, fmindex, simhash, substrings

from .helpers import SF, awkward, frame, ids

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- SimHash -----------------------------------------------------------------------------------------------------

def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs of (id, fingerprint) -> least id reachable."""
    label = {}
    for start, (i, f) in enumerate(pairs):
        if start in label:
            continue
        todo, seen = [start], {start}
        while todo:
            a = todo.pop()
            for b, (_, g) in enumerate(pairs):
                if b not in seen and (pairs[a][1] ^ g).bit_count() <= 2:
                    seen.add(b)
                    todo.append(b)
        known = [pairs[a][0] for a in seen if pairs[a][0] is not None]
        for a in seen:
            label[a] = min(known) if known else None
    return label


def check_simhash(df):
    source = [(r.doc_id, plain_simhash(r.text)) for r in df.collect()]
    label = plain_components(source)
    want = Counter((i, f"{f:016x}", label[k]) for k, (i, f) in enumerate(source))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(df).collect())
    assert got == want


def test_simhash_of_documents(docs):
    check_simhash(docs)


def test_simhash_of_awkward_rows(spark):
    check_simhash(awkward(spark))
    assert simhash.report(frame(spark, [])).count() == 0


def test_masks_cover_the_radius():
    masks = simhash.masks()
    assert len(masks) == 7
    rng = random.Random(1)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
        assert any(not flip & m for m in masks)


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:20]:  # crowded balls and chains around some of them
        for _ in range(40):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2)))
            fps.add(f)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    label = plain_components([(f, f & (1 << 64) - 1) for f in fps])
    want = {f: label[k] for k, f in enumerate(fps)}
    got = {f: f for f in fps} | {r.node: r.root for r in components.roots(simhash.links(nodes)).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.roots(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {499: 499, 500: 499}


def test_one_document_of_each_group_stays(spark, docs):
    found = simhash.components(docs)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted((True, r.c) for r in found.select(F.col("component_id").alias("c")).distinct().collect())
    odd = awkward(spark)
    assert simhash.keep_first(odd).columns == odd.columns


def test_every_component_keeps_one_row_whatever_its_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))
    clean, shared = [text() for _ in range(8)], text()
    source = [(None, t) for t in clean[:4]] + [(7, t) for t in clean[4:]]  # no id, or one id for all
    source += [(None, clean[0]), (7, clean[5])]  # exact copies
    source += [(3, shared), (7, shared), (None, shared)]
    rows = [(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(source)]
    docs = frame(spark, [], rows)
    kept = simhash.keep_first(docs).collect()
    assert sorted(r.text for r in kept) == sorted([*clean, shared])
    assert [r.doc_id for r in kept if r.text == shared] == [3]
    again = simhash.keep_first(docs.orderBy(F.desc("source")).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept))

    odd = awkward(spark)
    source = [(i, plain_simhash(r.text)) for i, r in enumerate(odd.collect())]
    assert simhash.keep_first(odd).count() == len(set(plain_components(source).values()))


# ---- repeated passages -------------------------------------------------------------------------------------------

def check_substrings(df, window=35):
    source = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect()]
    count = Counter(tuple(w[i:i + window]) for _, w in source for i in range(len(w) - window + 1))
    want = Counter()
    for i, w in source:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                keep[k:k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        want[(i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    out = substrings.report(df)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want


def test_repeats_in_documents(docs):
    check_substrings(docs)


def test_repeats_in_awkward_rows(spark):
    check_substrings(awkward(spark))
    assert substrings.report(frame(spark, [])).count() == 0


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(substrings, "MAX_SEGMENTS", 5)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    monkeypatch.setattr(substrings, "HEAVY_ROWS", 50)


@pytest.mark.parametrize("split", [False, True])
def test_repeats_at_the_edges_of_shared_passages(spark, request, split):
    if split:  # many shards, and minimizers that are compared window by window
        request.getfixturevalue("small_shards")
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 30))] + passage[rng.randint(0, 10):rng.randint(40, 60)]
                      + [word() for _ in range(rng.randint(0, 30))]) for _ in range(40)]
    texts += ["la " * 200, "la " * 34, "a b " * 60, " ".join(passage), " ".join(passage) + " end", "x " * 5000,
              " ".join([word() for _ in range(50)] * 3)]
    check_substrings(frame(spark, texts))


def test_matching_statistics_against_counting():
    rng = random.Random(3)
    for _ in range(120):
        size, window = rng.choice([3, 4, 10, 50]), rng.choice([3, 5, 8])
        seqs = [np.array([rng.randrange(2, 2 + size) for _ in range(rng.randint(window, 20))])
                for _ in range(rng.randint(1, 12))]
        seqs.append(seqs[0][:max(window, len(seqs[0]) // 2)].copy())
        asked = sorted(rng.sample(range(len(seqs)), rng.randint(1, len(seqs))))
        count = Counter(tuple(s[i:i + window]) for s in seqs for i in range(len(s) - window + 1))
        for q, hit in zip(asked, fmindex.repeated_windows(seqs, asked, 2 + size, window)):
            s = seqs[q]
            assert list(hit) == [count[tuple(s[i:i + window])] > 1 for i in range(len(s) - window + 1)]


def test_segments_hold_each_window_once():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)).encode() for n in (0, 10, 34, 35, 36, 200, 1000)] + [b"x " * 300]
    words = substrings.Words(texts)
    text, first, size, least, content = words.segments(35)
    seen = Counter((int(t), int(s) + k) for t, s, n in zip(text, first, size) for k in range(n))
    assert seen == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t.split()) - 34))
    by_content = {}
    for t, s, n, m, g in zip(text, first, size, least, content):
        spelled = tuple(texts[t].split()[s:s + n + 34])
        assert by_content.setdefault((int(m), int(g)), spelled) == spelled


# ---- benchmark windows -------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def check_hits(docs, bench):
    windows = {}
    for r in bench.collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("null" if r.item_id is None else str(r.item_id))
    sizes = {len(w) for w in windows}
    want = Counter()
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    items |= found
        want[(r.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
              bool(hit))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in decontaminate.report(docs, bench).collect())
    assert got == want


def test_hits_in_documents(spark, docs):
    check_hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))


def items(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i % 12, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("block_words", [4_000_000, 40])
def test_hits_of_short_repeated_and_empty_items(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "MAX_BLOCK_WORDS", block_words)
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "Of", "ünd", "x9", "and", "日本"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    bench = items(spark, [text(n) for n in (0, 1, 2, 5, 9, 10, 11, 25)] + [None, "zzz qqq", "the", "one two three"])
    check_hits(frame(spark, [text(rng.randint(0, 60)) for _ in range(60)]), bench)
    check_hits(awkward(spark), bench)
    check_hits(frame(spark, ["a b c"]), bench.limit(0))


def test_cleaning_drops_documents_or_spans(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.report(docs, bench).where("contaminated").collect()}
    assert dirty
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted((True, r.doc_id) for r in docs.collect() if r.doc_id not in dirty)
    cut = decontaminate.clean(docs, bench, drop=False)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in cut.collect():
        assert r.doc_id in dirty or r.text == texts[r.doc_id]
    assert decontaminate.report(cut, bench).where("contaminated").count() == 0
    assert decontaminate.without_spans(b"a, b! c. d", [{"start": 1, "end": 3}]) == b"a, . d"
