"""Held-out accuracy of the trained models; packing and the pipeline against brute force."""

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from growthlens.llm import decontaminate, langid, packing, pii, queries, simhash, toxicity

from .helpers import SF, awkward, frame, ids

MORE = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


# ---- language ----------------------------------------------------------------------------------------------------

def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    out = queries.op10_langid(spark, MORE).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (fold(r.doc_id) == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_languages_of_awkward_rows(spark):
    odd = awkward(spark)
    model = langid.fit(spark.read.parquet(f"{MORE}/documents.parquet"))
    out = langid.predict(odd, model)
    assert out.columns == [c for c in odd.columns if c != "language"] + ["language"] or "language" in out.columns
    got = langid.report(odd)
    assert ids(got) == ids(odd)
    bare = {r.doc_id: r.lang_pred for r in got.collect()}
    assert bare[0] == bare[1] == bare[2] == bare[3] == "und"
    assert langid.report(frame(spark, [])).count() == 0
    assert ids(langid.keep_known(odd, 0.0)) == ids(got.where("lang_pred <> 'und'"))


def test_unlabelled_documents_stay(spark):
    docs = frame(spark, ["eins zwei drei", "日本語", "123 !?", None, ""]).withColumn("lang", F.lit(None).cast("string"))
    assert ids(corpus_pipeline.language_id(spark, docs, SF)) == [(True, 0), (True, 1)]
    assert corpus_pipeline.language_id(spark, docs, SF).columns == docs.columns


def test_pair_tables_are_the_convolution():
    rng = np.random.default_rng(1)
    model = langid.train([("hello world this is text", "a"), ("xyz qqq zzz www", "b")])
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    columns = langid._columns(model.embed[x])
    pooled = np.maximum((columns @ model.filters).max(axis=1) + model.bias, 0)
    want = langid._softmax(pooled @ model.out + model.out_bias)
    assert np.allclose(langid.probabilities(model, langid.pair_tables(model), x), want, atol=1e-4)


# ---- toxicity ----------------------------------------------------------------------------------------------------

def test_held_out_toxicity(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    out = queries.op4_toxicity(spark, MORE).collect()
    assert all(r.held_out == (fold(r.doc_id) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [(r.score, toxic[r.doc_id]) for r in out if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8 and np.mean([g >= 0.7 for g in good]) < 0.05


def planted(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "re", "mi", "to", "lu", "ne"]) for _ in range(rng.randint(1, 4)))
    docs = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        for _ in range(4 if i % 4 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vilest", "vermin,", "zork" + word()]))
        docs.append((" ".join(words), int(i % 4 == 0)))
    return docs


def test_planted_words_are_tagged():
    model = toxicity.train(planted(400))
    emissions = toxicity.Emissions(model)
    text = "bare mito vilest vermin lune, tolu zorkmimi re".encode()
    p = toxicity.marginals([toxicity.fold_words(text)], emissions)[0]
    assert [x > 0.5 for x in p] == [False, False, True, True, False, False, True, False]
    assert toxicity._spans("é vilest é vermin".encode(), np.array([0.1, 0.9, 0.1, 0.9])) == [
        {"start": 2, "end": 8}, {"start": 11, "end": 17}]


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2, 2))
    lengths = np.array([4, 0, 1, 6])
    d = rng.normal(size=11)
    forward, backward = toxicity.Batch(lengths).messages(d, a)
    got, at = 1 / (1 + np.exp(-(forward + backward))), 0
    for n in lengths:
        mass, marked = 0.0, np.zeros(n)
        for state in range(2 ** n):
            y = [state >> k & 1 for k in range(n)]
            score = np.exp(sum(d[at + k] * y[k] for k in range(n)) + sum(a[y[k - 1], y[k]] for k in range(1, n)))
            mass += score
            marked += score * np.array(y)
        assert np.allclose(got[at:at + n], marked / mass)
        at += n


def test_toxicity_of_awkward_rows(spark):
    odd = awkward(spark)
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (5, None), (5, 1)], "doc_id long, toxic int")
    out = toxicity.report(odd, labels)
    assert ids(out) == ids(odd)
    model = toxicity.train(planted(200))
    scored = toxicity.score(odd, model)
    assert all(0 <= r.toxicity.score < 0.7 for r in scored.collect())
    assert toxicity.report(frame(spark, []), labels).count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------

def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    plain = Tokenizer.from_file(TOKENIZER)
    odd = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "İ", "ß", "Σ", "ς", "ſ", "é",
           "e\u0301", "Ǆ", "ǅ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "don't", "ﬁ", "½", "٣", "日本", "a", "Zürich",
           "42", "-", "!?", ".", "ª", "×", "\u0301", "\x00", "\x7f", "🙂", "ĸ", "word.", "Word,"]
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_every_latin_letter():
    """Capitals such as U+0181 and U+018F lower to letters beyond the ones that are cut here."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = ["Əli", "Ɓaba", "Ɔkra Ɛdan"]
    for ch in map(chr, [*range(0xC0, 0x250), 0x1E9E, 0x212A, 0x212B]):
        texts += [ch, f"{ch}li", f"Ab{ch}", f"x{ch}y1", f"{ch}!", f"'{ch}B-c", f"{ch}{ch}'s a{ch}."]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), dtype="<u4").tolist() == want, text


def check_packing(df):
    plain = Tokenizer.from_file(TOKENIZER)
    want = []
    for r in df.collect():
        x = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(r.doc_id, k // 2048, k, len(x[k:k + 2048]), zlib.crc32(x[k:k + 2048].tobytes()))
                 for k in range(0, len(x), 2048)]
    out = packing.pack_documents(df, TOKENIZER).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in out) // 2048)
    return len(by), least


def test_packed_documents(spark):
    used, least = check_packing(spark.read.parquet(f"{SF}/documents.parquet"))
    assert used <= least + 1
    check_packing(awkward(spark))
    assert packing.pack_documents(frame(spark, []), TOKENIZER).count() == 0


def test_local_search_beats_best_fit():
    rng = random.Random(1)
    lengths = [rng.randint(300, 700) for _ in range(1500)]
    first = packing.Bins(lengths, 2048)
    first.best_fit()
    best = packing.pack(lengths)
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in best)
    assert len(best) < len(first.items)
    assert packing.pack([]) == [] and packing.pack([2048, 2048, 5]) == [[0], [1], [2]]


def gaining(bins):
    """Whether some exchange (one item for none, one or two, or two for one) raises the sum of squared fills."""
    size, open_ = bins.lengths, [b for b, items in enumerate(bins.items) if items and bins.free[b]]
    ones = {b: {size[i] for i in bins.items[b]} for b in open_}
    twos = {b: {size[i] + size[j] for i, j in combinations(bins.items[b], 2)} for b in open_}
    for a in open_:
        for b in open_:
            moves = [x - y for x in ones[a] for y in {0} | ones[b] | twos[b]] + [x - y for x in twos[a] for y in ones[b]]
            if a != b and any(0 < m <= bins.free[b] and m + bins.free[a] > bins.free[b] for m in moves):
                return True
    return False


@pytest.mark.parametrize("low, high, n, capacity", [
    (513, 1000, 600, 2048), (1, 900, 400, 2048), (300, 1100, 300, 2048), (600, 700, 300, 2048), (2, 9, 2000, 700)])
def test_local_search_ends_in_a_local_optimum(low, high, n, capacity):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(n)]
    bins = packing.Bins(lengths, capacity)
    for i in range(n):  # next fit, with up to 350 items a bin
        if not bins.items or bins.free[-1] < lengths[i] or rng.random() < 0.004:
            bins.items.append([])
            bins.free.append(capacity)
        bins.items[-1].append(i)
        bins.free[-1] -= lengths[i]
    bins.improve()
    used = sum(map(bool, bins.items))
    assert sorted(i for items in bins.items for i in items) == list(range(n))
    assert all(capacity - sum(lengths[i] for i in items) == free >= 0 for items, free in zip(bins.items, bins.free))
    assert used == bins.fewest() or not gaining(bins)


def test_a_full_group_with_a_perfect_packing():
    rng, lengths = random.Random(1), []
    while len(lengths) < packing.GROUP_PIECES:
        a, b = rng.randint(513, 1000), rng.randint(513, 1000)
        if 513 <= 2048 - a - b <= 1000:
            lengths += [a, b, 2048 - a - b]
    found = packing.pack(lengths)
    assert sorted(i for items in found for i in items) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in items) <= 2048 for items in found)
    assert len(found) < 1.02 * len(lengths) / 3


# ---- the pipeline ------------------------------------------------------------------------------------------------

def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out = stage(spark, docs, SF)
        if name == "language_id":
            assert ids(out) == ids(docs)  # clean documents all have a language
        elif name == "near_dedup":
            found = simhash.components(docs)
            assert out.count() == found.select("component_id").distinct().count()
        elif name == "decontamination":
            hit = decontaminate.report(docs, bench).where("contaminated")
            assert ids(out) == ids(docs.join(hit, "doc_id", "left_anti"))
        elif name == "pii":
            assert ids(out) == ids(docs)
            assert pii.report(out).agg(*[F.sum(f"n_{k}") for k in pii.BASE]).first() == (0, 0, 0, 0)
            assert out.where("n_chars <> char_length(text)").count() == 0
        else:
            assert sorted({r.doc_id for r in out.collect()}) == sorted(r.doc_id for r in docs.collect())
            break
        assert out.columns == columns
        docs = out


def test_stages_take_awkward_rows(spark):
    odd = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_run_equals_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
