"""Fingerprints, URL rules, personal data and shards against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from growthlens.llm import fingerprints, pii, queries, sharding, url_filter

from .helpers import AWKWARD, DOCS, SF, awkward, frame, ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- fingerprints ------------------------------------------------------------------------------------------------

def shingles(text):
    w = [x for x in re.split("[ \t-\r]+", text.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_texts_and_likeness(spark, docs):
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(texts)
    errors = []
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        n = len(text)
        edited = text[:n - n // 2] + after[:n // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == n
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = shingles(text), shingles(other)
            errors.append(abs(value - (len(a & b) / len(a | b) if a | b else 1.0)))
            assert 0 <= value <= 1
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.25
    by_text = {}
    for i, text in texts:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_of_awkward_rows(spark):
    df = awkward(spark)
    out = fingerprints.edit_likeness(df)
    assert ids(out) == ids(df)
    for r in out.collect():
        assert re.fullmatch("[0-9a-f]{256}", r.fingerprint) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.edit_likeness(frame(spark, [])).count() == 0
    alone = fingerprints.edit_likeness(frame(spark, ["just one text of six words"])).first()
    assert alone.near_next == 1.0  # its own neighbour


def test_likeness_follows_jaccard_at_many_sizes(spark):
    rng = random.Random(5)
    pairs = []
    for n in (3, 20, 200, 3000):
        for share in (0.0, 0.3, 0.8, 1.0):
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            cut = int(n * share)
            b = a[:cut] + [f"w{rng.randrange(10**9)}" for _ in range(n - cut)]
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    value = fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")),
                                  fingerprints.no_words(F.col("a")), fingerprints.no_words(F.col("b")))
    for r in df.select("a", "b", value.alias("v")).collect():
        x, y = shingles(r.a), shingles(r.b)
        assert abs(r.v - len(x & y) / len(x | y)) < 0.15


# ---- URL rules ---------------------------------------------------------------------------------------------------

def judged(spark, urls, rules=None):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x"))
    rules = rules or url_filter.PATH_RULES + url_filter.PATTERN_RULES
    return {r.page_id: r for r in url_filter.judge(df, rules).collect()}


def test_rules_by_hand(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://example.net/EN/", "http://xnet/", "http://net/",
            "http://b.net", "http://b.net?x=/", "ftp://u.example.com/de/1#t", "http://example.com/fr/", "http://w.org/fr/",
            "http://www.spam-farm.com/", "http://notspam-farm.com/", "http://x.gov/affiliate/7/click?a=1",
            "http://free-mp3-download.co/", "a://b://c.net/z", "http://ex.com/a?clickid=3"]
    got = judged(spark, urls)
    want = {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
            3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.net", "/EN/", "net/", "block"),
            5: ("xnet", "/", None, "allow"), 6: ("net", "/", "net/", "block"), 7: ("b.net", "", None, "allow"),
            8: ("b.net", "", None, "allow"), 9: ("u.example.com", "/de/1", "example.com/de/", "block"),
            10: ("example.com", "/fr/", None, "allow"), 11: ("w.org", "/fr/", "org/fr/", "allow"),
            12: ("www.spam-farm.com", "/", None, "block"), 13: ("notspam-farm.com", "/", None, "allow"),
            14: ("x.gov", "/affiliate/7/click", None, "block"), 15: ("free-mp3-download.co", "/", None, "block"),
            16: ("b:", "//c.net/z", None, "allow"), 17: ("ex.com", "/a", None, "block")}
    for i, (host, path, rule, verdict) in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), urls[i]


def test_index_finds_what_every_regex_finds(spark):
    rng = random.Random(3)
    parts = ["ads", "net", "x", "shop", "track", "en", "com", "a-b", "9"]
    rules = [url_filter.Rule(f"r{i}", rng.choice(["block", "allow"]), rng.choice(["", "||"]) + "".join(
        rng.choice(parts) + rng.choice(["/", ".", "*", "^", "-", ""]) for _ in range(rng.randint(1, 3)))) for i in range(60)]
    urls = ["http://" + ".".join(rng.choice(parts) for _ in range(3)) + "/" + "/".join(
        rng.choice(parts) for _ in range(rng.randint(0, 3))) + rng.choice(["", "?ads=1", "#x"]) for _ in range(150)]
    got = judged(spark, urls, rules)
    for i, url in enumerate(urls):
        fits = [(len(r.pattern), r.action == "allow", r.action, r.name) for r in rules
                if re.search(r.regex(), url.split("://")[1])]
        assert got[i].verdict == (max(fits)[2] if fits else "allow"), url


def test_repeated_pages_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/")] * 3 + [(None, None)] * 2, "page_id long, url string")
    out = url_filter.judge(df, url_filter.PATH_RULES)
    assert Counter((r.page_id, r.verdict) for r in out.collect()) == {(1, "block"): 3, (None, "allow"): 2}
    assert url_filter.judge(df.limit(0), url_filter.PATH_RULES).count() == 0


def test_url_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = con.execute(queries.ORACLE["op2_url_filters"]).fetchall()
    got = queries.op2_url_filters(spark, SF).select("page_id", "host", "path", "rule", "verdict", "pattern").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# ---- personal data -----------------------------------------------------------------------------------------------

def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def only(t):
    return re.sub("[^0-9]", "", t)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15)]


def expected(text):
    found = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0])]
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
    return Counter(k for k, _, _ in found), digest


def check_pii(df):
    texts = Counter()
    for r in df.collect():
        counts, digest = expected(r.text)
        texts[(r.doc_id, counts["email"], counts["ip"], counts["card"], counts["phone"], digest)] += 1
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(df).collect())
    assert got == texts


def test_base_spans_of_documents(docs):
    check_pii(docs)


def test_base_spans_of_awkward_texts(spark):
    rng = random.Random(11)
    alphabet = ["1", "12", "4111111111111111", "a@b.co", "@", ".", "-", " ", "+1", "(", ")", "é", "🙂", "x", "_", "%", "255",
                "256", "0001", "a.b@c-d.e", "4111 1111 1111 1111", "10.0.0.1", "+44 20 7946 0958", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "é a@b.co é", "1" * 20_000, "a" * 50_000, "1 " * 20_000,
              "a.b@" + "c." * 5_000 + "d", "+1" + " " * 20_000, "+" * 3_000, "1." * 9_999]
    check_pii(frame(spark, texts))
    check_pii(awkward(spark))
    assert pii.report(frame(spark, [])).count() == 0


def test_added_kinds_need_their_checks(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 now", "pay DE89 3704 0044 0532 0130 01 now", "my ssn is 123-45-6789",
             "part 123-45-6789 of the set", "GB82WEST12345698765432"]
    got = [r.spans for r in pii.report(frame(spark, texts)).orderBy("doc_id").collect()]
    assert ["iban" in s for s in got] == [True, False, False, False, True]
    assert got[2].startswith("ssn:10:21") and "ssn" not in got[3]


def test_redaction_leaves_nothing_and_touches_nothing_else(spark, docs):
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for r in docs.collect():
        counts, _ = expected(r.text)
        assert not sum(expected(out[r.doc_id])[0].values())
        assert sum(counts.values()) or "[" in (r.text or "") or out[r.doc_id] == r.text
    one = pii.redact(frame(spark, ["mail é a@b.co and 4111 1111 1111 1111, or 4111 1111 1111 1112!", None])).orderBy("doc_id")
    assert [r.text for r in one.collect()] == ["mail é [EMAIL] and [CARD], or 4111 1111 1111 1112!", None]


def test_overlapping_spans_are_cut_whole(spark):
    texts = ["call +33.1.42.68.53.00 now", "é +3782 822463 10005, a@1.2.3.4.com and a@b.co", "4111 1111 1111 1111 10.0.0.1",
             "a@b.co c@d.org" + " 10.0.0.1" * 50, "ssn 078-05-1120", ""]
    out = pii.redact(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in out] == [
        "call [PHONE] now", "é [PHONE], [EMAIL] and [EMAIL]", "[CARD] [IP]", "[EMAIL] [EMAIL]" + " [IP]" * 50,
        "ssn [SSN]", ""]


# ---- shards ------------------------------------------------------------------------------------------------------

def test_ring_walk_fills_shards_evenly():
    rng = random.Random(2)
    nodes = sharding.ring(24)
    arcs = sharding.arc_of(nodes)
    loads = Counter()
    for _ in range(20_000):
        loads[arcs[rng.randrange(sharding.SLOTS)]] += rng.randint(10, 100)
    loads[5] += sum(loads.values()) // 2  # a hot arc
    total = sum(loads.values())
    capacity = -(-total // 24) + 50
    _, cuts = sharding.place(nodes, 24, capacity, [], loads)
    held = Counter()
    for arc, low, high, shard in cuts:
        held[shard] += high - low
    assert sum(held.values()) == total and max(held.values()) <= capacity
    for arc in loads:
        spans = sorted((a, b) for x, a, b, _ in cuts if x == arc)
        assert spans[0][0] == 0 and spans[-1][1] == loads[arc] and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))


def check_shards(df, slack):
    out = sharding.assign(df).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    for shard, rows_ in by.items():
        assert 0 <= shard < 24 and sorted(r.slot for r in rows_) == list(range(len(rows_)))
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(24)]
    largest = max((r.size for r in out), default=0)
    assert max(sizes) - sum(sizes) / 24 <= max(largest, slack * sum(sizes) / 24)
    return out


def test_shards_of_documents_and_of_a_hot_text(spark, docs):
    check_shards(docs, 0.05)
    hot = frame(spark, ["the same text for a third of all rows"] * 2000 + [f"text number {i} " + "x" * (i % 50) for i in range(4000)])
    out = check_shards(hot, 0.02)
    shards = {}
    for r in out:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) < 40  # equal texts part only where a shard is full


def test_shards_of_awkward_rows(spark):
    check_shards(awkward(spark), 1.0)
    assert sharding.assign(frame(spark, [])).count() == 0
    assert sharding.assign(frame(spark, [None])).first().size == 8
    assert len(AWKWARD) and DOCS
