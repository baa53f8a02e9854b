"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prosemill.llm import decontam, htmlmain, langid, licenses, lmscore, neardup, oracles, quality, queries, spm, urlfilter, warc

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NONSPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, n_words string, kept string, score int, __x int"


def texts():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    own = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(12)]
    near = [own[0].replace("w1 ", "zz ", 1), own[0] + " tail", own[1].upper(), own[1]]
    return [None, "", " \n\t", "one two", "one two", "日本語 テキスト です ね はい そう", "a" * 3000, ("long text " * 20000), *own, *near]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(k, t, "en" if k % 2 else "fr", "clash", "clash", 1, 2) for k, t in enumerate(rows)], DOCS)


def test_quality(spark):
    df = docs(spark)
    again = df.union(df.filter("doc_id = 9")).union(spark.createDataFrame([(None, "x", None, "", "", 0, 0)], DOCS))
    rows = quality.score_quality(again).collect()
    assert len(rows) == df.count() + 2
    assert next(r for r in rows if r.doc_id == 0).base_failed
    assert [r.kept for r in rows if r.doc_id == 9] == [True, True]
    kept = quality.filter_quality(again)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert quality.score_quality(df.limit(0)).count() == 0


def brute_links(items, percent=85):
    sets = {}
    for k, t in items:
        w = NONSPACE.findall((t or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    label = {k: k for k in sets}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def near_copies(n=260, seed=4):
    """Copies of one text with a few words replaced, so that links are many and some at the threshold."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(150)]
    out = []
    for k in range(n):
        own = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 6])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(4)}-{k % 5}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit", [1024, 24])
def test_near_duplicates(spark, limit):
    items = list(enumerate(texts() + near_copies()))
    df = docs(spark, [t for _, t in items])
    rules = neardup.JoinRules(node_limit=limit, max_depth=6, trees=8 if limit > 100 else 16)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link_classes(df, rules=rules).collect()}
    expected = brute_links(items)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    wrong = [k for k in expected if got[k] != expected[k]]
    assert len(wrong) <= (0 if limit > 100 else len(items) // 50), wrong


def test_near_duplicate_filter(spark):
    df = docs(spark)
    twice = df.union(df.filter("doc_id = 8"))
    kept = neardup.filter_near_duplicates(twice)
    assert kept.columns == df.columns
    expected = [k for k, v in brute_links(list(enumerate(texts()))).items() if v[2]]
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert neardup.link_classes(df.limit(0)).count() == 0
    assert neardup.link_classes(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first().kept


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {200: 100, 300: 100}


def test_decontamination(spark):
    rng = random.Random(3)
    long = [" ".join(f"b{rng.randrange(500)}" for _ in range(30)) for _ in range(6)]
    items = [(1, long[0]), (2, long[1]), (3, "tiny item"), (4, None), (5, ""), (2, long[1]), (6, long[0][: len(long[0]) // 2])]
    inside = [f"x y {long[0].upper()} z", " ".join(long[1].split()[5:16]), " ".join(long[1].split()[5:14]), "a tiny item, a tiny. Item!", long[0].replace(" ", "-"), None]
    df = docs(spark, texts() + inside)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    got = {r.doc_id: r for r in decontam.contamination_report(df, bench).collect()}
    for k, t in enumerate(texts() + inside):
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, its = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [1] * n
                    its |= windows[tuple(w[i : i + n])]
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), sum(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), sum(hit) > 0)
    clean = decontam.filter_contaminated(df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [k for k, r in sorted(got.items()) if not r.contaminated]
    assert decontam.contamination_report(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination_report(df.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"p{k} q{k} r{k} s{k} t{k} u{k} v{k} w{k} x{k} y{k} z{k}") for k in range(9)], "item_id bigint, text string")
    df = docs(spark, ["lead " + " and ".join(f"p{k} q{k} r{k} s{k} t{k} u{k} v{k} w{k} x{k} y{k} z{k}" for k in own) for own in ([0, 3, 8], [1], [])])
    whole = [tuple(r) for r in decontam.contamination_report(df, bench).sort("doc_id").collect()]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert len(list(decontam.item_blocks(bench, "item_id", "text", 10))) > 2
    assert [tuple(r) for r in decontam.contamination_report(df, bench).sort("doc_id").collect()] == whole
    assert [r[3] for r in whole] == [3, 1, 0]


def test_licenses(spark):
    notices = ["Licensed under the Apache License, Version 2.0.", "x MIT License y mit-license", "Licensed under CC BY-NC 4.0.", "under the GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3.", "the apache and the license", None]
    df = docs(spark, notices + texts())
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for k, t in enumerate(notices + texts()):
        w = ALNUM.findall((t or "").translate(LOWER))
        at = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert [got[k].labels for k in range(6)] == ["apache,apache-2.0", "mit", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "gpl,gpl-3.0", ""]
    assert got[0].score == 1.0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    rows = [make(["ta", "ki", "mo"]) if k % 2 else make(["gr", "ou", "ez"]) for k in range(120)] + [None, "12 34 !!", ""]
    df = docs(spark, rows)
    model = langid.fit(df, rules=langid.LangRules(steps=120, batch=128, hidden=6))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [got[k].lang_pred == ("en" if k % 2 else "fr") for k in range(120) if got[k].held_out]
    assert held and sum(held) / len(held) > 0.95
    assert [(got[k].lang_pred, got[k].score) for k in (120, 121, 122)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.filter_languages(df, model)
    assert kept.columns == df.columns
    assert kept.count() == 120
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_codec(spark):
    pytest.importorskip("sentencepiece")
    df = docs(spark, [t for t in texts()] + ["a▁b", "x\ny  z"])
    held = spm.codec(df)
    rows = spm.encode(df, held)
    back = {r.doc_id: r.text for r in spm.decode(rows, held).collect()}
    got = {r.doc_id: r for r in rows.collect()}
    for k, t in enumerate([*texts(), "a▁b", "x\ny  z"]):
        assert back[k] == (None if t is None else t.replace("▁", " "))
        assert got[k].round_trip == (t is not None and "▁" not in t)
    assert (got[0].ids, got[0].n_tokens, got[1].ids) == (None, 0, [])
    assert spm.encode(df.limit(0), held).count() == 0


def test_cross_entropy(spark):
    rows = ["aaaa abab", "abab aaaa ab", "zzzz zyzy", "zyzz", None, ""]
    df = docs(spark, rows)
    target = spark.createDataFrame([(0,), (1,), (1,), (99,)], "id bigint")
    got = {r.doc_id: r for r in lmscore.score_cross_entropy(df, target).collect()}
    k = 8.0

    def grams(t):
        b = b"\0\0\0" + t.encode()
        return [tuple(b[i - 3 : i + 1]) for i in range(3, len(b))]

    def model(ids, weight=1.0):
        c = [Counter() for _ in range(5)]
        for i in ids:
            for g in grams(rows[i] or ""):
                for n in range(1, 5):
                    c[n][g[4 - n :]] += weight

        def p(g):
            if not g:
                return 1 / 256
            context = sum(v for h, v in c[len(g)].items() if h[:-1] == g[:-1])
            return (c[len(g)][g] + k * p(g[1:])) / (context + k)

        return p

    import math

    tokens = [len((r or "").encode()) for r in rows]
    t, b = model([0, 1]), model(range(2, 6), (tokens[0] + tokens[1]) / sum(tokens[2:]))
    for i in range(4):
        own = grams(rows[i])
        assert got[i].n_tokens == len(own)
        assert got[i].score == pytest.approx(sum(math.log(b(g)) - math.log(t(g)) for g in own) / len(own), abs=1e-5)
    assert got[0].score < 0 < got[2].score
    assert got[4].score is None and got[5].n_tokens == 0


def test_cross_entropy_of_odd_rows(spark):
    rows = [(1, "abcd abcd"), (1, "abcd abcd"), (None, "abcd"), (2, None), (3, "xy " * 200_000)]
    df = spark.createDataFrame([(*r, 0, 0.0, "c") for r in rows], "doc_id bigint, text string, n_tokens int, score double, gram string")
    target = spark.createDataFrame([(1,), (None,)], "doc_id bigint")
    got = sorted(((r.doc_id, r.n_tokens, r.score is None or r.score < 0) for r in lmscore.score_cross_entropy(df, target).collect()), key=str)
    assert got == sorted([(1, 9, True), (1, 9, True), (None, 4, True), (2, 0, True), (3, 600_000, False)], key=str)
    none = lmscore.score_cross_entropy(df, target.limit(0)).filter("doc_id = 1").first()
    assert none.target_loss == pytest.approx(5.545, abs=1e-3) and none.background_loss < 5
    assert lmscore.score_cross_entropy(df.limit(0), target).count() == 0


def test_cross_entropy_in_blocks(spark, monkeypatch):
    df, target = docs(spark, texts()[8:14]), spark.createDataFrame([(0,), (1,)], "id bigint")
    whole = [(r.doc_id, round(r.score, 5)) for r in lmscore.score_cross_entropy(df, target).sort("doc_id").collect()]
    monkeypatch.setattr(lmscore, "BLOCK_ROWS", 100)
    assert [(r.doc_id, round(r.score, 5)) for r in lmscore.score_cross_entropy(df, target).sort("doc_id").collect()] == whole


def test_urls(spark):
    rows = [(1, "http://EXAMPLE.com/en/71?x"), (2, "https://a.example.com/en/8"), (3, "https://b.net/de/8"), (4, "https://x.example.net/de/80#f"), (5, "//none"), (6, None), (7, "ftp://org"), (8, "http://bad.host.info/x"), (8, "http://bad.host.info/x"), (9, "http://notexample.com.evil/en/7")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([(8, True), (1, False), (2, False), (3, None)], "p bigint, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, outcomes).collect()}
    assert got[1] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("net/de/", "block")
    assert got[4][2:] == ("example.net/de/8", "block")
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][:3] == ("org", "", None)
    assert got[9][2] is None
    assert urlfilter.judge_urls(pages, outcomes).count() == len(rows)
    assert urlfilter.judge_urls(pages.limit(0), outcomes).count() == 0


def test_host_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("a.x.com", 200, 190), ("b.x.com", 1, 1), ("c.y.com", 200, 5), ("d.y.com", 0, 0), ("e.z.org", 150, 10)], "host string, n bigint, k bigint")
    got = {r.host: r for r in urlfilter.host_reputation(hosts).collect()}
    assert got["a.x.com"].bound > 0.8
    assert got["d.y.com"].mean < 0.2 < got["b.x.com"].mean < got["a.x.com"].mean
    assert all(r.bound <= r.mean for r in got.values())


def test_warc(spark):
    payloads = ["<p>é</p>", None, "", "same", "same", "same", "big" * 400_000]
    pages = spark.createDataFrame([(k, f"http://h/{k} ü", p, "clash") for k, p in enumerate(payloads)] + [(None, None, "alone", "")], "page_id bigint, url string, html string, payload_bytes string")
    rules = warc.WarcRules(archive_bytes=500_000)
    got = {r.page_id: r for r in warc.round_trip(pages, rules=rules).collect()}
    assert len(got) == len(payloads) + 1
    for k, p in enumerate(payloads):
        data = (p or "").encode()
        first = max(i for i, q in enumerate(payloads) if (q or "") == (p or ""))
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if k == first else "revisit", None if k == first else first)
    assert got[None].record_type == "response"
    small = {r.page_id: r.record_type for r in warc.round_trip(pages, rules=warc.WarcRules(min_bytes=5)).collect()}
    assert small[3] == small[1] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_main_text(spark):
    page = "<html><body><div class='x'>Shared banner {h}</div><p>Own text {k}</p><ul><li>a{k}<li>b</ul></body></html>"
    rows = [(k, f"http://h{k % 2}/p", page.replace("{h}", "here").replace("{k}", str(k))) for k in range(12)] + [(20, None, None), (21, "http://z/", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in htmlmain.extract_main_text(pages).collect()}
    assert all(got[k].text == f"Own text {k}\na{k}\nb" for k in range(12))
    assert (got[20].text, got[20].n_chars, got[21].text) == ("", 0, "")
    assert htmlmain.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    rel = con.sql(oracles.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA).select(*rel.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_decontamination_of_odd_rows(spark):
    passage = " ".join(f"q{k}" for k in range(14))
    bench = spark.createDataFrame([(None, passage, "c"), (None, "other tiny", "c"), (3, passage, "c"), (3, passage, "c"), (4, None, "c")], "item_id bigint, text string, n_hit string")
    rows = [(1, f"a {passage} b"), (1, f"a {passage} b"), (None, "OTHER tiny"), (2, None), (3, "x " * 300_000 + passage)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id bigint, text string, items string, n_words string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.contamination_report(df, bench).collect()), key=str)
    name = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([(1, 16, 14, 2, name("3")), (1, 16, 14, 2, name("3")), (None, 2, 2, 1, name("")), (2, 0, 0, 0, name("")), (3, 300_014, 14, 2, name("3"))], key=str)
    clean = decontam.filter_contaminated(df, bench)
    assert clean.columns == df.columns and [r.doc_id for r in clean.collect()] == [2]


def test_language_of_odd_rows(spark):
    rows = [(k, "ta ki mo " * 8 if k % 2 else "grou ezgr " * 7, "en" if k % 2 else "fr") for k in range(40)] + [(50, "ta ki", "en"), (50, "ta ki", "en"), (None, "grou ez", "fr"), (51, None, "en"), (52, "", None), (53, "1 2 3", "en"), (54, "ta mo " * 200_000, None), (55, "", "en")]
    df = spark.createDataFrame([(*r, "c", 0.0) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score double")
    model = langid.fit(df, rules=langid.LangRules(steps=60, batch=32, hidden=4))
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (51, 52, 53, 55)] == [("und", 0.0)] * 4
    assert (by_id[None].lang_pred, by_id[None].held_out, by_id[54].lang_pred) == ("fr", False, "en")
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 50}) == 1
    kept = langid.filter_languages(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
