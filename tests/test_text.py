from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosemill.functions import html
from prosemill.functions.text import heading_level, heading_text, markdown_masker, mask_comments, sentences_of, spans
from prosemill.operators import metrics, morphemes
from prosemill.plans import lint
from prosemill.rules.packs import JA, LATIN


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr).first()[0]


@pytest.mark.parametrize(
    ("text", "masked"),
    [("a\n```\nb\n``\n```` x\n````\nc", "a\n\n\n\n\n\nc"), ("a\n---\nb", "a\n---\nb"), ("---\na", "\n"), ("x <!-- y\n```\nz --> w", "x       \n\n"), ("1. a\n2) b\nc|d\n|--|--|", "\n\nc|d\n"), ("![alt](u v) `` a`b ``", "![alt](   )          ")],
)
def test_mask(spark, text, masked):
    assert one(spark, text, markdown_masker()("text")) == masked


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a`~#-<!>| \n[](x)。", max_size=40), min_size=1, max_size=20))
def test_mask_keeps_lengths(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", markdown_masker()("text").alias("m"), mask_comments(F.col("text")).alias("c")).collect()
    for r in rows:
        pairs = list(zip(r.text.split("\n"), r.m.split("\n"), strict=True))
        assert all(m in ("", m) and len(m) in (0, len(t)) for t, m in pairs)
        assert len(r.c) == len(r.text)


def test_spans_equal_finditer(spark):
    text, pattern = "ab12 c345d 6 日本7x", "[0-9]+"
    got = one(spark, text, F.expr(spans("text", pattern)))
    assert [(r.start, r.hit) for r in got] == [(m.start(), m[0]) for m in re.finditer(pattern, text)]
    assert one(spark, "none", F.expr(spans("text", pattern))) == []


def test_sentences_keep_raw_offsets(spark):
    row = lint.prepare(spark.createDataFrame([(1, "前`ab。c`後。　次！\n\n- x\n末")], "doc_id int, text string")).first()
    assert [(s.line, s.raw) for s in row.sentences] == [(1, "前`ab。c`後"), (1, "次"), (4, "末")]
    assert [[x.no for x in p] for p in row.paragraphs] == [[1], [4]]
    assert sentences_of("lines", LATIN.delimiters)


def test_headings(spark):
    for line, level, text in [("## a b ##", 2, "a b"), ("#x", None, None), ("### c#", 3, "c#"), ("#", 1, "")]:
        assert one(spark, line, F.expr(heading_level("text"))) == level
        if level:
            assert one(spark, line, F.expr(heading_text("text"))) == text


def test_entities_and_tags(spark):
    assert one(spark, "&amp;lt; &#65;&#x3042;&#xZ; &nbsp;x", html.unescape_entities(F.col("text"))) == "< Aあ&#xZ;  x"
    assert one(spark, "<script>a</script><h2 class='x'>b <i>c</i></h2><p>d<br>e</p><h3></h3>", html.strip_tags(F.col("text"))) == "## b c\n\nd\n\ne"
    assert one(spark, "<H3>a &amp;lt; <b>b</b></H3>x\r\ny<h2>c<h1>d</h1></h2>", html.strip_tags(F.col("text"))) == "### a < b\n\nx\n\ny\n\n## cd"


def test_baseline_of_itself_persists(spark):
    docs = lint.prepare(spark.createDataFrame([(1, "重要なのは速度。重要なのは精度。"), (2, "このように。")], "doc_id int, text string"))
    found = lint.run_lint(docs, JA)
    assert {r.status for r in lint.baseline_diff(found, found).collect()} == {"persisting"}
    assert {r.status for r in lint.baseline_diff(found, found.limit(0)).collect()} == {"new"}


def test_baseline_json_skips_bad_elements(spark):
    raw = spark.createDataFrame([(1, '{"findings": [{"category": "a", "excerpt": "b"}, 3, {"category": "c"}]}')], "doc_id int, json string")
    assert [r.valid for r in lint.valid_baseline(raw).sort("ix").collect()] == [True, False, False]


def test_morpheme_rules(spark):
    docs = lint.prepare(spark.createDataFrame([(1, "これは意味するものを示す。")], "doc_id int, text string"))
    rows = [(1, 1, 0, i, s, p, "*", d, s, b, b + len(s)) for i, (s, p, d, b) in enumerate([("これ", "代名詞", "これ", 0), ("は", "助詞", "は", 2), ("事", "名詞", "事", 3), ("を", "助詞", "を", 4), ("示す", "動詞", "示す", 5)])]
    m = spark.createDataFrame(rows, "doc_id int, line_no int, sent_ix int, ix int, surface string, pos0 string, pos1 string, dict_form string, reading string, begin int, end int")
    found = lint.run_lint(morphemes.attach_precomputed(docs, m), JA).filter("category = 'inanimate_subject_morph'").collect()
    assert [(r.line, r.detail) for r in found] == [(1, "示す")]


def test_mtld(spark):
    words = ["a", "b", "c", "a"] * 10

    def factor(tokens):
        count, seen, n = 0.0, set(), 0
        for t in tokens:
            seen.add(t)
            n += 1
            if len(seen) / n <= 0.72:
                count, seen, n = count + 1, set(), 0
        if n:
            count += (1 - len(seen) / n) / (1 - 0.72)
        return len(tokens) / count

    got = spark.range(1).select(F.expr(metrics.mtld("array(" + ",".join(f"'{w}'" for w in words) + ")"))).first()[0]
    assert got == pytest.approx((factor(words) + factor(words[::-1])) / 2)
    assert spark.range(1).select(F.expr(metrics.mtld("array('a')"))).first()[0] is None


def test_decode(spark):
    rows = [("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("<meta charset='utf-8'>é".encode(), None), (b"x", "charset=shift_jis")]
    text, name = html.decode_html(F.col("b"), F.col("h"))
    got = spark.createDataFrame(rows, "b binary, h string").select(text.alias("t"), name.alias("n")).collect()
    assert [tuple(r) for r in got] == [("é", "iso-8859-1"), ("<meta charset='utf-8'>é", "utf-8"), (None, "shift_jis")]


def test_heading_grammar(spark):
    df = spark.sql("select 1 doc_id, 1 line, 1 level, array(named_struct('pos0', '名詞'), named_struct('pos0', '助詞'), named_struct('pos0', '名詞'), named_struct('pos0', '補助記号')) morphemes")
    from prosemill.operators import outline

    g = outline.heading_grammar(df)
    assert tuple(g.first())[3:] == ("名詞/名詞", True)
    assert {(r.level, r.dominant_share, r.nominal_ratio) for r in outline.signature_shares(g).collect()} == {(1, 1.0, 1.0), (None, 1.0, 1.0)}


JA_DOCS = [
    (1, "しかし、重要なのは速度ではなく、精度である。\n\nまた、それは品質を示す。これは大事なことである。なぜなら理由があるからだ。\n\nそして安全ではなく、価格だ。短い。"),
    (2, "一文だけ。\n二行目です！\n\n三行目？"),
    (3, "さて、始めよう。\nこのように進む。"),
    (4, "段落が続く。終わる。\n\n次も続く。終わる。\n\nまた続く。終わる。\n\n最後も続く。終わる。"),
]


def test_japanese_findings(spark):
    docs = lint.prepare(spark.createDataFrame(JA_DOCS, "doc_id int, text string"), JA)
    found = lint.run_lint(docs, JA, experimental=True)
    got = {(r.doc_id, r.line, r.category, r.severity) for r in found.filter("category <> 'low_sentence_variance'").collect()}
    assert got == {(1, 1, "forbidden_phrase", "info"), (1, 3, "english_syntax_inanimate_subject", "info"), (3, 1, "forbidden_phrase", "info"), (3, 2, "forbidden_phrase", "info"), (4, 1, "uniform_paragraph_structure", "info"), (1, 3, "english_syntax_cleft_because", "warn"), (1, 1, "paragraph_lead_conjunction", "info"), (1, 3, "paragraph_lead_conjunction", "info"), (1, 5, "paragraph_lead_conjunction", "info")}
    one = lint.run_lint(docs, JA, experimental=True, categories=["forbidden_phrase", "english_syntax_cleft_because"])
    assert {(r.doc_id, r.line, r.category) for r in one.collect()} == {x[:3] for x in got if x[2] in ("forbidden_phrase", "english_syntax_cleft_because")}
    assert lint.run_lint(docs, JA, categories=[]).count() == 0


@pytest.mark.parametrize(
    ("text", "left"),
    [("a\n```py\nb\n~~~\nc\n```\nd", {1: "a", 7: "d"}), ("---\nt: 1\n---\nx", {4: "x"}), ("a <!-- b\nc --> d", {1: "a       ", 2: "      d"}), ("# h\ntext `code` [n](http://u)\n- i\n> q\n| a | b |", {2: "text        [n](        )"}), ("~~~\nopen\nend", {}), ("a <!--> b", {1: "a       b"}), ("plain\ntext", {1: "plain", 2: "text"})],
)
def test_masked_lines(spark, text, left):
    from prosemill.functions.text import mask_markdown

    masked = one(spark, text, mask_markdown(F.col("text")))
    assert {k: x for k, x in enumerate(masked.split("\n"), 1) if x} == left


def test_outline(spark):
    from prosemill.operators import outline

    indented = "".join("\n  続き" for _ in range(40))
    text = f"# はじめに #\n\n最初の文。次の文。\n\n- a{indented}\n- b\n- c\n## 1. 背景\n本文。\n```\n# x\n~~~\n- y\n``` z\n```\n字下げ\n  の行"
    docs = lint.prepare(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), JA)
    got = [(r.line, r.kind, r.level, r.text) for r in outline.outline(docs, JA).sort("line").collect()]
    assert got == [(1, "heading", 1, "はじめに"), (3, "lead", None, "最初の文"), (5, "bullets", None, "(3 items)"), (48, "heading", 2, "1. 背景"), (49, "lead", None, "本文"), (56, "lead", None, "字下げ")]


def test_readability_counts(spark):
    text = "例えば、これは行くことができない。たとえばなくはないし、することができます。１2.5.x\n\n" + "あ" * 101 + "。"
    docs = lint.prepare(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), JA)
    got, none = metrics.readability(docs, JA).sort("doc_id").collect()
    assert (got.n_sentences, got.comma_density, got.double_negation, got.redundant, got.notation_pairs) == (4, 0.5, 1, 1, 1)
    assert (got.full_period, got.half_period, got.full_digit, got.half_digit, got.period_mixed, got.comma_mixed, got.digit_mixed) == (3, 0, 1, 2, False, False, True)
    assert (got.long_share, got.conjunction_rate) == (0.25, 0.5)
    assert (none.n_sentences, none.kanji_ratio, none.katakana_ratio, none.comma_density, none.sentence_mean, none.redundant, none.paragraph_cv) == (0, None, None, None, None, 0, None)


def test_terms_follow_morphemes(spark):
    from prosemill.operators import outline

    docs = lint.prepare(spark.createDataFrame([(1, "# 東京タワーとは\n東京タワー（塔）はHTTPで Big Data を読む。\nカタ カタカナ語")], "doc_id int, text string"), JA)
    pieces = "transform(case when l.text like '東京タワーとは' then array('東京', 'タワー', 'とは') when l.text like '東京%' then array('東京', 'タワー', '（塔）は', 'HTTP', 'で', ' ', 'Big', ' ', 'Data') else array('カタ', ' ', 'カタカナ', '語') end, p -> struct(p as surface, '名詞' as pos0, if(p = '東京', '固有名詞', '*') as pos1, instr(l.text, p) - 1 as begin, instr(l.text, p) - 1 + length(p) as end))"
    got = [(r["term"], r["first_line"], r["count"], r["has_gloss_hint"]) for r in outline.term_inventory(docs, pieces).sort("first_line", "place").collect()]
    assert got == [("東京", 1, 2, True), ("タワー", 1, 2, True), ("HTTP", 2, 1, True), ("Big", 2, 1, True), ("Data", 2, 1, True), ("カタカナ", 3, 1, True)]


def analysed(spark, text, sentences):
    """A document with analyser rows: per sentence its line and (surface, pos0, pos1, dict_form, reading)."""
    rows = []
    for k, (line, words) in enumerate(sentences):
        at = 0
        for i, (x, p0, p1, form, reading) in enumerate(words):
            rows.append((1, line, k, i, x, p0, p1, form or x, reading or x, at, at + len(x)))
            at += len(x)
    m = spark.createDataFrame(rows, "doc_id int, line_no int, sent_ix int, ix int, surface string, pos0 string, pos1 string, dict_form string, reading string, begin int, end int")
    return morphemes.attach_precomputed(lint.prepare(spark.createDataFrame([(1, text)], "doc_id int, text string")), m)


def noun(x, kind="普通名詞"):
    return (x, "名詞", kind, None, None)


def test_able_to_construction(spark):
    words = [noun("価値"), ("を", "助詞", "*", None, None), ("高める", "動詞", "*", None, None), noun("こと"), ("が", "助詞", "*", None, None), ("できる", "動詞", "*", None, None)]
    found = lint.run_lint(analysed(spark, "価値を高めることができる。", [(1, words)]), JA).filter("category = 'translationese_morph'").collect()
    assert [(r.line, r.excerpt) for r in found] == [(1, "価値を高めることができる")]


def test_low_specificity_of_paragraphs(spark):
    vague, named = "価値の本質と可能性を考える重要性。" * 8, "東京で三月に百人が働く会社の計画。" * 8
    words = [noun(x) for x in ("価値", "本質", "可能性", "重要性")] * 4
    names = [noun(x, "固有名詞") for x in ("東京", "三月", "会社", "計画")] * 4
    sentences = [(1, words)] * 8 + [(3, names)] * 8
    found = lint.run_lint(analysed(spark, f"{vague}\n\n{named}", sentences), JA, experimental=True, categories=["low_specificity"]).collect()
    assert [r.line for r in found] in ([1], [])  # abstract nouns are a fixed list
    from prosemill.rules import packs

    own = [noun(x) for x in packs.ABSTRACT_NOUNS[:4]] * 4
    found = lint.run_lint(analysed(spark, f"{vague}\n\n{named}", [(1, own)] * 8 + [(3, names)] * 8), JA, experimental=True, categories=["low_specificity"]).collect()
    assert [r.line for r in found] == [1]


def test_no_nominal_ending(spark):
    said = [noun("話"), ("が", "助詞", "*", None, None), ("続く", "動詞", "*", None, None)]
    text = ("話が続く" + "あ" * 500 + "。") * 5
    found = lint.run_lint(analysed(spark, text, [(1, said)] * 5), JA, categories=["nominal_ending"]).collect()
    assert [(r.line, r.category) for r in found] == [(1, "nominal_ending")]
    assert lint.run_lint(analysed(spark, text, [(1, said)] * 4 + [(1, [*said, noun("事")])]), JA, categories=["nominal_ending"]).count() == 0
