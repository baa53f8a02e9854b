"""Array kernels and array operators against plain Python, without Spark."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prosemill.llm import htmlmain, langid, lmscore, neardup, quality, spm, warc
from prosemill.llm import textops as T

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NONSPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = ["", " ", "\n\n", "a", "a b c d e", "é日本 Ａ b", "a\x00b\x0bc", "x" * 5000, "w1 w2 w3 w4 w5 " * 3000, None, "same\nsame\n \nsame", "A a Ä ä"]


def column(items):
    return T.texts(pa.array(items, pa.string()))


def samples(n=60, seed=3):
    rng = random.Random(seed)
    letters = "ab é\n\t,.#日"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize(("table", "pattern"), [(T.NONSPACE, NONSPACE), (T.ALNUM, ALNUM)])
def test_words(table, pattern):
    items = samples()
    t = column(items)
    data = T.LOWER[t.data]
    w = T.words(t, table, data)
    got = [[bytes(data[w.start[k] : w.end[k]]).decode() for k in range(w.bounds[r], w.bounds[r + 1])] for r in range(len(t))]
    assert got == [pattern.findall((x or "").translate(LOWER)) for x in items]


def test_sliced_column():
    a = pa.array(["aa", "bb", "cc"]).slice(1, 2)
    t = T.texts(a)
    assert bytes(t.data) == b"bbcc"
    assert t.bounds.tolist() == [0, 2, 4]


def test_equal_spans_hash_equally():
    t = column(["ab cd ab", "ab cd"])
    w = T.words(t, T.NONSPACE)
    h = T.SpanHash(t.data)(w.start, w.end)
    assert h[0] == h[2] == h[3]
    assert h[0] != h[1]
    assert T.grams(h, 2)[0] == T.gram_hash(h[3:5])


def brute_quality(x):
    x = x or ""
    w = NONSPACE.findall(x)

    def cover(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if c[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        return hit

    seen, lines, chars = set(), 0, 0
    for line in x.split("\n"):
        if NONSPACE.search(line):
            if line in seen:
                lines, chars = lines + 1, chars + sum(map(len, NONSPACE.findall(line)))
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", x)), "n_dup_lines": lines, "dup_line_chars": chars, "n_repeat_words": sum(cover(5)), "g7": sum(len(a) for a, h in zip(w, cover(7), strict=True) if h)}


def test_quality():
    items = samples() + ["one two three four five six seven eight nine ten\n" * 2, "a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    m = quality.measure(column(items), quality.QualityRules())
    m["g7"] = m["dup_gram_chars"][7]
    for i, x in enumerate(items):
        assert {k: int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", "g7")} == brute_quality(x)
    assert m["kept"][-1]
    assert not m["kept"][-2]


def test_codec_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    codec = spm.Codec(spm.Vocabulary.load())
    rng = random.Random(1)
    items = [x for x in samples() if x is not None] + ["hello  world", " a", "a ", "日本🦄", "<s>a<0x41>", " " * 40 + "x" + " " * 33, "a▁b", "-" * 70] + ["".join(rng.choice("abcdefghij ,.AEéü\n -_=日本Пр") for _ in range(80)) for _ in range(300)]
    t = column(items)
    for _ in range(2):  # the second time from what is remembered
        ids, bounds = codec.encode(t)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [lib.encode(x) for x in items]
    data, edges = codec.decode(ids, bounds)
    assert [bytes(data[a:b]).decode() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [x.replace("▁", " ") for x in items]


def test_codec_forgets():
    codec = spm.Codec(spm.Vocabulary.load())
    codec.REMEMBERED = 50
    for k in range(5):
        ids, _ = codec.encode(column([f"word{k} other{k * 7} " * 30]))
        assert len(ids)


def test_gru_gradients():
    rules = langid.LangRules(hidden=3)
    model = langid.ByteGru(["a", "b"], rules)
    x = np.random.RandomState(0).randint(0, 5, (4, 6))  # noqa: NPY002
    y = np.array([0, 1, 0, 1, 1, 0])

    def loss():
        p = model.probabilities(x)
        return float(-np.log(p[:, y, np.arange(6)]).mean())

    for name, grad in model.gradients(x, y).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = model.p[name][at]
        model.p[name][at] = kept + 1e-2
        up = loss()
        model.p[name][at] = kept - 1e-2
        down = loss()
        model.p[name][at] = kept
        assert grad[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def brute_pooled(model, text):
    """Byte by byte, window by window, with plain loops."""
    rules, data = model.rules, (text or "").encode()
    h = rules.hidden
    total = np.zeros(len(model.langs))
    for at in range(0, len(data), rules.window):
        low, high = max(at - rules.context, 0), min(at + rules.window + rules.context, len(data))
        x = [langid.PAD] * (rules.context - (at - low)) + list(data[low:high])
        x += [langid.PAD] * (min(rules.window, len(data) - at) + 2 * rules.context - len(x))
        states = []
        for d in (0, 1):
            s, own = np.zeros(h), {}
            for k in range(len(x))[:: 1 if d == 0 else -1]:
                g, a = model.p[f"w{d}"][x[k]].astype(float), s @ model.p[f"u{d}"].astype(float)
                z, r = (1 / (1 + np.exp(-(g[i * h : (i + 1) * h] + a[i * h : (i + 1) * h]))) for i in (0, 1))
                s = ((1 - z) * np.tanh(g[2 * h :] + r * a[2 * h :]) + z * s) * (x[k] != langid.PAD)
                own[k] = s
            states.append(own)
        for k in range(rules.context, rules.context + min(rules.window, len(data) - at)):
            e = np.exp(np.concatenate((states[0][k], states[1][k])) @ model.p["v"].astype(float) + model.p["c"])
            total += e / e.sum()
    return total / max(len(data), 1)


def test_pooling_equals_brute_force():
    model = langid.ByteGru(["a", "b", "c"], langid.LangRules(hidden=3, window=20, context=4))
    items = [x for x in samples(12) if x is None or len(x) < 3000] + ["short", "exactly twenty bytes", "x" * 301, "é日本" * 30, "short"]
    got = model.pooled(column(items))
    for x, p in zip(items, got, strict=True):
        assert p == pytest.approx(brute_pooled(model, x), abs=1e-5)


def test_padding_does_not_train():
    model = langid.ByteGru(["a", "b"], langid.LangRules(hidden=3))
    x = np.random.RandomState(0).randint(0, 5, (4, 6)).astype(np.uint8)  # noqa: NPY002
    y = np.array([0, 1, 0, 1, 1, 0])
    grad = model.gradients(np.concatenate((x, np.full((2, 6), langid.PAD, np.uint8))), y)
    for name, g in model.gradients(x, y).items():
        assert grad[name] == pytest.approx(g, abs=1e-7)
    assert np.abs(grad["w0"][langid.PAD]).max() == np.abs(grad["w1"][langid.PAD]).max() == 0


def test_gru_learns():
    rules = langid.LangRules(hidden=4, steps=120, batch=64)
    windows = np.array([list(w * 16) for w in (b"abab", b"baba", b"aabb", b"xyxy", b"yxyx", b"xxyy")], np.uint8)
    p = langid.ByteGru(["l", "r"], rules).train(windows, np.array([0, 0, 0, 1, 1, 1])).pooled(column(["abba baab", "xyyx yxxy", "", None, "x" * 900]))
    assert p[0, 0] > 0.8
    assert p[1, 1] > 0.8
    assert p[2].tolist() == p[3].tolist() == [0, 0]
    assert p[4, 1] > 0.5


def test_four_grams():
    t = column(["abcde", "", "é"])
    raw = [b"\0\0\0abcde", b"\0\0\0", "\0\0\0é".encode()]
    expected = [int.from_bytes(r[k - 3 : k + 1], "big") for r in raw for k in range(3, len(r))]
    assert lmscore.four_grams(t).tolist() == expected


def test_intersections_and_components():
    rng = np.random.RandomState(2)  # noqa: NPY002
    sets = [np.unique(rng.randint(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = neardup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)
    assert neardup._roots_of(6, np.array([5, 4, 1]), np.array([4, 3, 0])).tolist() == [0, 0, 2, 3, 3, 3]


def test_shingles():
    items = samples()
    g, bounds = neardup.shingle_sets(column(items), 5)
    for x, n in zip(items, np.diff(bounds).tolist(), strict=True):
        w = NONSPACE.findall((x or "").translate(LOWER))
        assert n == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert (neardup.minwise(g, bounds)[np.diff(bounds) == 0] == 0xFFFFFFFF).all()


def test_main_text():
    html = """<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="ad big">buy</div>
    <article><h1>A &amp; B</h1><p>one<br>two <i>three</i><p>four&nbsp;five<div class="comments"><p>me too</p></div><script>x("<p>")</script></article>
    <!-- <p>no</p> --><footer>f</footer>"""
    assert htmlmain.main_text(html) == "A & B\none two three\nfour five"
    assert htmlmain.main_text(None) == htmlmain.main_text("") == ""
    assert htmlmain.main_text("<p>a</p><div><p>b</div>") == "a\nb"
    assert htmlmain.main_text("a < b & c") == "a < b & c"
    page = "<body><div class='x'>same</div><p>text</p>"
    assert htmlmain.main_text(page, frozenset({x.key for x in htmlmain.Page(page).nodes if x.tag == "div"})) == "text"


def test_warc_streams():
    rows = [(1, "http://a/ b", "é" * 10), (None, None, ""), (3, "http://c", "x" * 3_000_000)]
    whole = [warc.record("response", i, u, p.encode(), warc.payload_digest(p.encode()), None, "2024-01-01T00:00:00Z") for i, u, p in rows]
    import gzip
    import io

    mono = gzip.compress(b"".join(whole))
    assert list(warc.records(warc.inflated(io.BytesIO(mono).read))) == whole
    many = b"".join(map(gzip.compress, whole))
    assert list(warc.records(warc.inflated(io.BytesIO(many).read))) == whole
    parsed = [warc.parse_record(gzip.compress(w)) for w in whole]
    assert [(p["page_id"], p["payload"].decode()) for p in parsed] == [(i, p) for i, _, p in rows]
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(iter([b"".join(whole)[:-10]])))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(gzip.compress(whole[0].replace("é".encode(), b"xx", 1)))
