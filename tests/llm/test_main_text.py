"""The style tree against a brute-force one, with the tree and the names switched off, and odd pages."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from prosemill.llm import htmlmain
from prosemill.llm.htmlmain import Page, TreeRules, main_text

SCHEMA = "page_id bigint, url string, html string, text string"


def template(k, host="h"):
    """Boilerplate without any telling name: the same strap line and link rows on every page."""
    links = "".join(f"<div><a href='/{x}'>{x}</a></div>" for x in ("home", "about", "contact"))
    return (k, f"http://{host}/{k}", f"<html><body><div class='x1'><div class='x2'>We sell the best lamps of the town</div>{links}</div><div class='x3'><h1>Title {k}</h1><p>Own text number {k} of this site, long enough to count.</p><p>Every article says this.</p><div class='x4'>Read on about {k * 7}</div></div><div class='x5'>Call us today</div></body></html>", "clash")


def test_the_tree_decides(spark):
    pages = spark.createDataFrame([template(k) for k in range(9)] + [template(50, "alone")], SCHEMA)
    got = {r.page_id: r for r in htmlmain.extract_main_text(pages).collect()}
    for k in range(9):
        assert got[k].text == f"Title {k}\nOwn text number {k} of this site, long enough to count.\nEvery article says this.\nRead on about {k * 7}"
        assert got[k].tree_chars > 0 and got[k].name_chars == 0
    off = {r.page_id: r for r in htmlmain.extract_main_text(pages, rules=TreeRules(min_importance=-1.0, min_inside=-1.0)).collect()}
    assert all("Call us today" in off[k].text and off[k].text != got[k].text for k in range(9))
    assert got[50].text == off[50].text  # a host of one page has no statistics


def test_names_are_not_needed_where_the_tree_has_seen_enough(spark):
    rows = [(k, "http://h/", f"<nav><a>Home</a><a>News</a></nav><article><p>Article {k} about {k * k}</p></article><div class='ad'>Buy now</div><footer>All rights</footer>", "") for k in range(20)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = htmlmain.extract_main_text(pages, rules=TreeRules(names=False)).collect()
    assert all(r.text == f"Article {r.page_id} about {r.page_id**2}" for r in got)


def test_a_home_is_kept_whatever_its_name(spark):
    rows = [(k, "http://h/", f"<div class='notice'><p>{'word ' * k} the only text of page {k}</p></div><div class='ad'>Buy</div>", "") for k in range(8)]
    got = htmlmain.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.text.endswith(f"the only text of page {r.page_id}") for r in got)


def test_copies_in_a_rarer_layout_stay(spark):
    rows = [(k, "http://h/", f"<div class='a'><p>Text {k} of many different ones on this host</p></div>", "") for k in range(30)] + [(100 + k, "http://h/", "<div class='b'><p>One notice, copied</p></div>", "") for k in range(9)]
    got = {r.page_id: r.text for r in htmlmain.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + k] == "One notice, copied" for k in range(9)) and got[3].startswith("Text 3")


def brute_tree(pages, rules):
    """Importance and mass of every branch, page by page and branch by branch, from the branch's path."""
    path = lambda x: tuple(y.key for y in x.above())
    per_host = defaultdict(list)
    for host, html in pages:
        page = Page(html)
        shapes, texts = defaultdict(set), set()
        for x in page.nodes:
            if not x.hidden:
                shapes[x.key].add(" ".join(x.kids))
        for x, text in page.texts():
            texts.add((x.key, frozenset(path(x)), text))
        per_host[host].append((shapes, texts))
    out = {}
    for host, own in per_host.items():
        whole = sum(len(t) for _, _, t in {t for _, texts in own for t in texts})
        for key in {k for shapes, _ in own for k in shapes}:
            with_it = [(shapes, texts) for shapes, texts in own if key in shapes]
            m = len(with_it)
            presentation = Counter(frozenset(shapes[key]) for shapes, _ in with_it)
            shown = Counter(t for _, texts in own for t in texts if key in t[1])
            if m > 1:
                p = -sum(c / m * math.log(c / m, m) for c in presentation.values())
                raw = p if not shown else (1 - rules.content_share) * p + rules.content_share * -sum(c / sum(shown.values()) * math.log(c / m, m) for c in shown.values())
            else:
                raw = 1.0
            mass = sum(len(t) for _, _, t in shown) / whole if whole else 0.0
            out[host, key] = m, (m * raw + rules.prior_pages) / (m + rules.prior_pages), mass
    return out


def test_tree_equals_brute_force(spark):
    rng = random.Random(11)
    tags = ["div", "p", "ul", "li", "section", "span", "nav", "table", "tr", "td"]

    def piece(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["a b", "c", "d e f", "g" * rng.randrange(1, 9)])
        tag = rng.choice(tags)
        return f"<{tag}{rng.choice(['', ' class=k1', ' class=\"k2 k1\"', ' role=x'])}>{''.join(piece(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag}>"

    rows = [(f"h{k % 4}", "".join(piece(4) for _ in range(3))) for k in range(60)] + [("h9", "<p>alone"), ("h9", "")]
    rules = TreeRules()
    got = {(r.host, r.key): (r.m, r.importance, r.mass) for r in htmlmain.style_tree(spark.createDataFrame(rows, "host string, html string"), rules).collect()}
    expected = brute_tree(rows, rules)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div id='comment-policy-analysis'><p>Essay text</p></div>", "Essay text"),
        ("<p class='share-price'>price</p><div class='related-work'>work</div>", "price\nwork"),
        ("<article>a</article><div><p>second main para", "a\nsecond main para"),
        ("<article>a<div class='reader-comments'>no</div></article><div class='site-footer'>no</div><div id=cookie-notice>no</div>", "a"),
        ("<p>a <b>b</b>c<br>d &amp;lt; &lt;e&nbsp; f</p>", "a bc d &lt; <e f"),
        ("x < y and 3 <4 <", "x < y and 3 <4 <"),
        ("a<p title='x>y'>b</p><a href=\"u\"v\">c</a>", "a\nb\nc"),
        ("<p>one<p>two<li>three", "one\ntwo\nthree"),
        ("<form id=aspnetForm><p>the whole page stands in a form</p><input><select><option>x</select></form>", "the whole page stands in a form"),
        ("text<div class='comments'>a comment that is much longer than the text</div>", "text"),
        ("<ARTICLE><HEADER><H1>T</H1></HEADER>x</ARTICLE><header>no</header>", "T\nx"),
        ("cut <a href='", "cut"),
        ("<!-- no --><![CDATA[no]]><!doctype html>yes<!-- open", "yes"),
    ],
)
def test_single_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", ["<a " * 400_000, '<a "' * 400_000, '<a b="' * 400_000, "<a b='>' " * 100_000, "<div>" * 200_000 + "x", "<div class='q r'>x" * 100_000, "<p>x</q>" * 100_000, "<!--" * 300_000, "<p>" + "word " * 300_000])
def test_long_pages_take_linear_time(html):
    began = time.time()
    main_text(html)
    list(Page(html).style())
    assert time.time() - began < 20


def test_odd_rows(spark):
    rows = [(1, None, "<p>x"), (1, None, "<p>x"), (None, "http://h/", "<p>y"), (2, "http://h/", None), (3, "no host", "")]
    pages = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id bigint, url string, html string, text string, host string, keys string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in htmlmain.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, None, "x", 1), (1, None, "x", 1), (None, "http://h/", "y", 1), (2, "http://h/", "", 0), (3, "no host", "", 0)], key=str)
    assert htmlmain.extract_main_text(pages.limit(0)).count() == 0
