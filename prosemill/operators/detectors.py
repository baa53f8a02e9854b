"""Detectors: each is SQL for an array of findings of one document, over its array columns.

Columns they read: ``text`` (line ends normalised), ``bare`` (comments blanked),
``lines``, ``sentences``, ``paragraphs`` and, for the morpheme rules, ``tokens``.
As a detector is one expression, a whole pass is one projection without a
shuffle, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.text import heading_level, heading_text, let, quoted, shown, spans, ustrip
from ..rules import packs
from ..rules.packs import Pack, Profile

FINDING = "struct<line:int,category:string,excerpt:string,severity:string,detail:string,related_lines:array<int>>"
MORPHEME = "struct<surface:string,pos0:string,pos1:string,dict_form:string,reading:string,begin:int,end:int>"
TOKENS = f"array<struct<line:int,masked:string,raw:string,morphemes:array<{MORPHEME}>>>"
NONE = f"cast(array() as array<{FINDING}>)"
Detector = Callable[[Pack, Profile], str]


def words(items) -> str:
    return "array(" + ", ".join(quoted(x) for x in items) + ")" if items else "cast(array() as array<string>)"


def finding(line: str, category: str, excerpt: str, severity: str, detail: str, related: str = "cast(null as array<int>)") -> str:
    return f"cast(struct({line} as line, '{category}' as category, {excerpt} as excerpt, {severity} as severity, {detail} as detail, {related} as related_lines) as {FINDING})"


def moments(values: str) -> str:
    """SQL struct (n, mean, sd) of an array of numbers; population deviation."""
    mean = "aggregate(v, 0D, (a, x) -> a + x) / nullif(size(v), 0)"
    sd = "sqrt(aggregate(v, 0D, (a, x) -> a + (x - m) * (x - m)) / nullif(size(v), 0))"
    return let(values, "v", let(mean, "m", f"struct(size(v) as n, m as mean, {sd} as sd)"))


def around(raw: str, masked: str, start: str, length: str, margin: int = 10) -> str:
    """The raw text from ``margin`` before a place to ``margin`` behind it, or the masked text where raw is shorter."""
    cut = f"greatest({start} - {margin}, 0) + 1, {start} + {length} + {margin} - greatest({start} - {margin}, 0)"
    return ustrip(f"if(length({raw}) >= {start} + {length} + {margin}, substring({raw}, {cut}), substring({masked}, {cut}))")


def related(lines: str) -> str:
    return f"array_sort(array_distinct({lines}))"


def related_text(lines: str) -> str:
    return f"array_join(transform({related(lines)}, n -> concat('L', n)), ', ')"


def literal(text: str) -> str:
    """A pattern that matches a text as it stands."""
    return re.sub(r"[\\\[\]{}()*+?.^$|]", r"\\\g<0>", text)


def starts(pattern: str, width: int = 3) -> set[str]:
    """Strings with one of which every match of a pattern starts, up to about ``width`` characters; the empty one where that is not seen."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return {""}
    found, at, plain = {""}, 0, r"[^\\\[\]{}()*+?.^$|]"
    while min(map(len, found)) < width and (m := re.compile(rf"\(((?:{plain}|\|)+)\)|({plain})").match(pattern, at)):
        at = m.end()
        if pattern[at : at + 1] in ("?", "*", "+", "{"):
            break
        found = {a + b for a in found for b in (m[1].split("|") if m[1] else m[2])}
    return found


def sped(*patterns: str, width: int = 3) -> str:
    """A pattern that matches what any of the patterns does at the same places, told at most places by one character class."""
    first = set().union(*[starts(p, width) for p in patterns])
    classes = ["[" + "".join(sorted({re.escape(x[k]) for x in first})) + "]" for k in range(min(width, *map(len, first)))]
    # groups are captured for nothing, where no class or reference depends on their brackets
    bare = [p if re.search(r"[\\\[]", p) else re.sub(r"\((?!\?)", "(?:", p) for p in patterns]
    return (f"(?={''.join(classes)})" if classes else "") + "(?:" + "|".join(f"(?:{p})" for p in bare) + ")"


def forbidden_phrases(pack: Pack, _: Profile) -> str:
    if not pack.phrases:
        return NONE
    hit = finding("l.no", "forbidden_phrase", around("l.raw", "l.masked", "(instr(l.masked, p) - 1)", "length(p)"), f"if(array_contains({words(pack.weak)}, p), 'info', 'warn')", "concat('stock phrase: ', p)")
    # a line is read once for all phrases
    some = f"filter(lines, l -> l.masked rlike {quoted(sped(*map(literal, pack.phrases)))})"
    return f"flatten(transform({some}, l -> transform(filter({words(pack.phrases)}, p -> contains(l.masked, p)), p -> {hit})))"


def _matches(patterns, body: str, lines: str = "lines") -> str:
    each = [f"transform({spans('l.masked', sped(p))}, h -> {body.replace('$pattern', quoted(p))})" for p in patterns]
    # a line is read once for all patterns; what may be absent in front of a match finds no other lines
    any_ = [re.sub(r"^[.][{]0,[0-9]+[}]", "", p) for p in patterns]
    return f"flatten(transform(filter({lines}, l -> l.masked rlike {quoted(sped(*any_))}), l -> concat({', '.join(each)})))" if each else NONE


def calques(pack: Pack, _: Profile) -> str:
    return _matches(pack.calques, finding("l.no", "translationese", around("l.raw", "l.masked", "h.start", "length(h.hit)"), "'info'", "concat('pattern: ', $pattern)"))


def _exact(raw: str = "l.raw") -> str:
    return f"if(length({raw}) >= h.start + length(h.hit), substring({raw}, h.start + 1, length(h.hit)), h.hit)"


def antithesis(pack: Pack, p: Profile) -> str:
    hits = _matches(pack.antithesis, f"struct(l.no as line, {ustrip(_exact())} as excerpt)")
    if not pack.antithesis:
        return NONE
    severity = f"case when r < {p.antithesis_info_below}D then 'info' when r >= {p.antithesis_critical_from}D then 'critical' else 'warn' end"
    one = finding("x.line", "antithesis_repetition", "x.excerpt", severity, "concat(size(hs), ' contrasts, share of sentences ', format_number(r, 3))", related("transform(hs, y -> y.line)"))
    emitted = let("if(size(sentences) > 0, size(hs) / size(sentences), 0D)", "r", f"transform(hs, x -> {one})")
    return let(hits, "hs", f"if(size(hs) >= {p.antithesis_min}, {emitted}, {NONE})")


def low_variance(_: Pack, p: Profile) -> str:
    hit = finding("sentences[0].line", "low_sentence_variance", "concat('n=', s.n, ' mean=', format_number(s.mean, 1), ' cv=', format_number(s.sd / s.mean, 3))", "'warn'", "'sentence lengths hardly vary'")
    return let(moments("transform(sentences, x -> length(x.masked))"), "s", f"if(s.n >= {p.variance_min_sentences} and s.sd / s.mean < {p.variance_cv}D, array({hit}), {NONE})")


def paragraph_leads(pack: Pack, p: Profile) -> str:
    lead = f"transform(paragraphs, g -> struct(g[0].no as line, g[0].raw as raw, get(filter({words(pack.conjunctions)}, c -> startswith({ustrip('g[0].masked')}, c)), 0) as word))"
    one = finding("x.line", "paragraph_lead_conjunction", "substring(x.raw, 1, 40)", "'info'", "concat('paragraph starts with ', x.word)", related("transform(hs, y -> y.line)"))
    return let(f"filter({lead}, x -> x.word is not null)", "hs", f"if(size(paragraphs) >= {p.conjunction_min_paragraphs} and size(hs) >= {p.conjunction_ratio}D * size(paragraphs), transform(hs, x -> {one}), {NONE})")


def paragraph_counts(pack: Pack) -> str:
    return f"transform(paragraphs, g -> size(filter(split(array_join(transform(g, l -> l.masked), '\\n'), {quoted(pack.delimiters)}), x -> {shown('x')})))"


def uniform_paragraphs(pack: Pack, p: Profile) -> str:
    hit = finding("1", "uniform_paragraph_structure", "concat('paragraphs=', s.n, ' mean=', format_number(s.mean, 1))", "'info'", "'paragraphs have the same number of sentences'")
    return let(moments(paragraph_counts(pack)), "s", f"if(s.n >= {p.uniform_min_paragraphs} and coalesce(s.sd / nullif(s.mean, 0D), 0D) < {p.uniform_cv}D, array({hit}), {NONE})")


def inanimate_subjects(pack: Pack, _: Profile) -> str:
    return _matches(pack.inanimate, finding("l.no", "english_syntax_inanimate_subject", _exact(), "'info'", "'abstract subject with a transitive verb'"))


def cleft_because(pack: Pack, _: Profile) -> str:
    hit = finding("s.line", "english_syntax_cleft_because", "concat(s.raw, '。', sentences[i + 1].raw)", "'warn'", "'cleft sentence with its reason behind it'")
    pairs = f"transform(sentences, (s, i) -> if(s.masked rlike {quoted(pack.cleft)} and coalesce(get(sentences, i + 1).masked rlike {quoted(pack.because)}, false), {hit}, null))"
    return f"filter({pairs}, x -> x is not null)"


def _line_of(start: str) -> str:
    return f"1 + regexp_count(substring(bare, 1, {start}), '\\n')"


def _dense(pattern: str, category: str, least: int, per_1000: float | None) -> str:
    dense = f" and size(hs) * 1000D / greatest(length(bare), 1) >= {per_1000}D" if per_1000 is not None else ""
    hit = finding(_line_of("hs[0].start"), category, "concat(size(hs), ' places')", "'info'", "'more than usual'")
    return let(f"if(regexp_count(bare, {quoted(pattern)}) >= {least}, {spans('bare', pattern)}, cast(array() as array<struct<start:int,hit:string>>))", "hs", f"if(size(hs) >= {least}{dense}, array({hit}), {NONE})")


BOLD = "\\*\\*[^*\\n]+\\*\\*"
BULLET = "^(?U)\\s*([-*+]|\\d+[.)])(\\s|$)"
BARE_LINES = let("split(bare, '\\n')", "p", "transform(if(element_at(p, -1) = '', slice(p, 1, size(p) - 1), p), (x, i) -> struct(i + 1 as no, x as t))")


def bold_density(_: Pack, p: Profile) -> str:
    return _dense(BOLD, "high_bold_density", p.bold_min, p.bold_per_1000)


def bullet_ratio(_: Pack, p: Profile) -> str:
    hit = finding("coalesce(get(bs, 0).no, 1)", "high_bullet_ratio", "concat(size(bs), '/', size(ls), ' lines')", "'info'", "'mostly list items'", f"if(size(bs) > 1, {related('transform(bs, b -> b.no)')}, null)")
    inner = let(f"filter(ls, x -> x.t rlike {quoted(BULLET)})", "bs", f"if(size(ls) >= {p.bullet_min_lines} and size(bs) >= {p.bullet_ratio}D * size(ls), array({hit}), {NONE})")
    return let(f"filter({BARE_LINES}, x -> {ustrip('x.t')} <> '')", "ls", inner)


def boilerplate_headings(pack: Pack, _: Profile) -> str:
    hit = finding("x.no", "boilerplate_heading", f"substring({ustrip('x.t')}, 1, 40)", "'info'", "'stock heading'")
    title = "lower(" + ustrip("regexp_replace(x.t, '^(?U)\\\\s*#{1,6}(?=\\\\s|$)', '')") + ")"
    fits = f"{heading_level('x.t')} is not null and exists({words(pack.boilerplate)}, w -> startswith({title}, w))"
    return f"transform(filter({BARE_LINES}, x -> {fits}), x -> {hit})"


def numbered_phases(pack: Pack, p: Profile) -> str:
    return _dense(pack.phase, "numbered_phase_structure", p.phase_min, None)


def emoji_density(_: Pack, p: Profile) -> str:
    return _dense(packs.EMOJI, "high_emoji_symbol_density", p.emoji_min, p.emoji_per_1000)


# Rules over morphemes.

_EFFECTIVE = f"filter(t.morphemes, m -> not m.pos0 in {packs.TRAILING_POS})"
_CONTENT = f"filter(flatten(transform(tokens, t -> t.morphemes)), m -> m.pos0 in {packs.CONTENT_POS})"


def last_pos(morphemes: str) -> str:
    return f"element_at(filter({morphemes}, m -> not m.pos0 in {packs.TRAILING_POS}), -1).pos0"


def no_nominal_ending(_: Pack, p: Profile) -> str:
    hit = finding("element_at(tokens, -1).line", "nominal_ending", "concat('0 of ', size(tokens), ' sentences')", "'info'", "'no sentence ends in a noun'")
    count = f"size(filter(tokens, t -> coalesce(get(reverse({_EFFECTIVE}), 0).pos0 = '名詞', false)))"
    return f"if(size(tokens) >= {p.nominal_min_sentences} and length(text) >= {p.nominal_min_chars} and {count} <= {p.nominal_ratio}D * size(tokens), array({hit}), {NONE})"


def translationese_morphemes(_: Pack, __: Profile) -> str:
    run = "m[i].surface = 'こと' and m[i].pos0 = '名詞' and m[i + 1].pos0 = '助詞' and m[i + 1].surface in ('が', 'は') and m[i + 2].pos0 = '動詞' and startswith(m[i + 2].surface, 'でき')"
    excerpt = "substring(t.raw, m[greatest(i - 4, 0)].begin + 1, m[i + 2].end - m[greatest(i - 4, 0)].begin)"
    own = let("t.morphemes", "m", f"if(size(m) < 3, {NONE}, transform(filter(sequence(0, size(m) - 3), i -> {run}), i -> {finding('t.line', 'translationese_morph', excerpt, quoted('info'), quoted('able-to construction'))}))")
    return f"flatten(transform(tokens, t -> {own}))"


def mora_lengths() -> str:
    """Readings without small kana, except one in front; those of single bytes have none."""
    return "transform(tokens, t -> aggregate(t.morphemes, 0, (a, m) -> a + if(octet_length(m.reading) = length(m.reading), length(m.reading), length(regexp_replace(coalesce(m.reading, ''), '(?<!^)[ァィゥェォャュョヮ]', '')))))"


def correlation(xs: str) -> str:
    """SQL: lag-1 Pearson correlation of an array, null when either side is constant."""
    x, y = let(moments("slice(q, 1, size(q) - 1)"), "a", "a"), let(moments("slice(q, 2, size(q) - 1)"), "b", "b")
    cov = "aggregate(zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (u, w) -> (u - a.mean) * (w - b.mean)), 0D, (s, z) -> s + z) / (size(q) - 1)"
    return let(xs, "q", f"if(size(q) < 2, cast(null as double), {let(x, 'a', let(y, 'b', f'if(a.sd > 0 and b.sd > 0, {cov} / (a.sd * b.sd), cast(null as double))'))})")


def low_burstiness(_: Pack, p: Profile) -> str:
    hit = finding("tokens[0].line", "low_burstiness", "concat('burstiness=', format_number((s.sd - s.mean) / (s.sd + s.mean), 3))", "'warn'", "'sentence lengths hardly vary in morae'")
    return let(moments(mora_lengths()), "s", f"if(s.n >= {p.burstiness_min} and s.sd + s.mean > 0 and (s.sd - s.mean) / (s.sd + s.mean) < {p.burstiness}D, array({hit}), {NONE})")


def autocorrelation(_: Pack, p: Profile) -> str:
    hit = finding("tokens[0].line", "high_length_autocorrelation", "concat('r=', format_number(r, 3))", "'info'", "'a long sentence follows a long one'")
    return let(correlation(mora_lengths()), "r", f"if(size(tokens) >= {p.burstiness_min} and size(tokens) - 1 >= {p.autocorrelation_min} and r > {p.autocorrelation}D, array({hit}), {NONE})")


def repeated_leads(_: Pack, p: Profile) -> str:
    leads = "filter(transform(tokens, t -> if(size(t.morphemes) >= 2, struct(t.line as line, t.raw as raw, concat(t.morphemes[0].surface, t.morphemes[1].surface) as lead, (t.morphemes[0].pos1 = '固有名詞' or t.morphemes[0].surface rlike '^[A-Za-z]') as named), null)), x -> x is not null)"
    one = finding("x.line", "repeated_sentence_lead", "substring(x.raw, 1, 20)", "'info'", "concat(x.lead, if(x.named, ' (a name)', ''), ' starts many sentences')", "lines")
    # equal leads stand together when sorted, so the frequent ones need no counting by pairs
    often = let("array_sort(transform(hs, y -> y.lead))", "o", f"array_distinct(filter(o, (w, i) -> get(o, i + {p.lead_repeat - 1}) = w))")
    counts = let(often, "k", "filter(array_distinct(transform(hs, y -> y.lead)), w -> array_contains(k, w))")
    group = let("filter(hs, y -> y.lead = w)", "g", let(related("transform(g, y -> y.line)"), "lines", f"transform(g, x -> {one})"))
    return let(leads, "hs", f"if(size(hs) < {p.lead_repeat}, {NONE}, flatten(transform({counts}, w -> {group})))")


def repeated_templates(_: Pack, p: Profile) -> str:
    rows = "filter(transform(tokens, t -> if(size(t.morphemes) >= 4, struct(t.line as line, t.raw as raw, array_join(transform(slice(t.morphemes, 1, 4), m -> m.pos0), '/') as tags), null)), x -> x is not null)"
    # the most frequent one; of equal counts the first seen. Runs of the sorted tags give the counts
    run = "aggregate(array_sort(transform(hs, y -> y.tags)), struct('' as w, 0 as c, 0 as most), (a, x) -> if(x = a.w, struct(x as w, a.c + 1 as c, greatest(a.most, a.c + 1) as most), struct(x as w, 1 as c, greatest(a.most, 1) as most))).most"
    winners = let("array_sort(transform(hs, y -> y.tags))", "o", "array_distinct(filter(o, (w, i) -> get(o, i + c - 1) = w))")
    top = let(run, "c", let(winners, "v", "struct(get(filter(transform(hs, y -> y.tags), w -> array_contains(v, w)), 0) as w, c as c)"))
    one = finding("x.line", "repeated_syntax_template", "substring(x.raw, 1, 20)", "'info'", "concat(b.w, ' starts many sentences')", "lines")
    group = let("filter(hs, y -> y.tags = b.w)", "g", let(related("transform(g, y -> y.line)"), "lines", f"transform(g, x -> {one})"))
    return let(rows, "hs", f"if(size(hs) < {p.template_min}, {NONE}, {let(top, 'b', f'if(b.c >= {p.template_ratio}D * size(hs), {group}, {NONE})')})")


def type_token_ratio() -> str:
    return let(f"transform({_CONTENT}, m -> m.dict_form)", "w", "if(size(w) > 0, size(array_distinct(w)) / size(w), cast(null as double))")


def mtld(tokens: str, threshold: float = 0.72, least: int = 20) -> str:
    """SQL: measure of textual lexical diversity of an array of words, the mean of both directions; null under ``least`` words."""
    state = "struct(0D as factors, cast(array() as array<string>) as seen, 0 as n, 1D as ttr)"
    step = let("if(array_contains(a.seen, x), a.seen, array_append(a.seen, x))", "k", f"if(size(k) / (a.n + 1D) <= {threshold}D, struct(a.factors + 1D as factors, cast(array() as array<string>) as seen, 0 as n, 1D as ttr), struct(a.factors as factors, k as seen, a.n + 1 as n, size(k) / (a.n + 1D) as ttr))")
    one = lambda v: let(f"aggregate({v}, {state}, (a, x) -> {step})", "f", f"size(w) / nullif(f.factors + if(f.n > 0, (1 - f.ttr) / (1 - {threshold}D), 0D), 0D)")
    return let(tokens, "w", f"if(size(w) < {least}, cast(null as double), (coalesce({one('w')}, cast(size(w) as double)) + coalesce({one('reverse(w)')}, cast(size(w) as double))) / 2)")


def lexical_diversity(_: Pack, p: Profile) -> str:
    content = f"transform({_CONTENT}, m -> m.dict_form)"
    low = lambda name, cond, value: f"if({cond}, array({finding('1', name, f'format_number({value}, 3)', quoted('info'), quoted('few different words'))}), {NONE})"
    both = f"concat({low('low_lexical_diversity_ttr', f'r < {p.ttr}D', 'r')}, {low('low_lexical_diversity_mtld', f'd < {p.mtld}D', 'd')})"
    return let(content, "c", f"if(length(text) >= {p.diversity_min_chars} and size(c) >= {p.diversity_min_tokens}, {let('size(array_distinct(c)) / size(c)', 'r', let(mtld('c'), 'd', both))}, {NONE})")


def specificity_score(p: Profile) -> str:
    """SQL: of a paragraph ``g`` (lines, morphemes): the weighted shares of names, numbers and examples less those of abstract nouns; null for short ones."""
    body = "array_join(transform(g.lines, l -> l.masked), '\\n')"
    score = f"size(filter(c, m -> m.pos1 = '固有名詞')) * {p.proper_weight}D / size(c) + regexp_count({body}, {quoted(packs.NUMERIC_QUANTITY)}) * {p.numeric_weight}D / size(c) + if(exists({words(packs.EXAMPLE_MARKERS)}, w -> contains({body}, w)), {p.example_bonus}D, 0D) - size(filter(c, m -> m.pos0 = '名詞' and array_contains({words(packs.ABSTRACT_NOUNS)}, m.dict_form))) * {p.abstract_weight}D / size(c)"
    return let(f"filter(g.morphemes, m -> m.pos0 in {packs.CONTENT_POS})", "c", f"if(length({body}) >= {p.specificity_min_chars} and size(c) >= {p.specificity_min_words}, {score}, cast(null as double))")


def low_specificity(_: Pack, p: Profile) -> str:
    """Paragraphs of abstract nouns without names, numbers or examples; reads ``paragraph_tokens`` (morphemes of a paragraph's lines)."""
    hit = finding("g.lines[0].no", "low_specificity", "substring(g.lines[0].raw, 1, 40)", "'info'", "'abstract nouns without names, numbers or examples'")
    return f"flatten(transform(paragraph_tokens, g -> if({specificity_score(p)} < {p.specificity}D, array({hit}), {NONE})))"


def inanimate_morphemes(_: Pack, __: Profile) -> str:
    """Abstract subject, が or は, then the first later verb of the list; a word of an earlier subject starts none."""
    single = f"(m[i].surface in {packs.PRONOUNS} or (m[i].pos0 = '名詞' and m[i].surface in {packs.FORMAL_NOUNS}))"
    double = f"(i + 1 < size(m) and concat(m[i].surface, m[i + 1].surface) in {packs.PRONOUN_PHRASES})"
    subjects = f"transform(filter(sequence(0, size(m) - 1), i -> {single} or {double}), i -> struct(i as a, if({single}, i, i + 1) as b))"
    # a subject inside the span of the one before it is skipped
    apart = f"aggregate({subjects}, cast(array() as array<struct<a:int,b:int>>), (k, x) -> if(size(k) > 0 and x.a <= element_at(k, -1).b, k, array_append(k, x)))"
    verb = f"get(filter(sequence(x.b + 2, greatest(size(m) - 1, x.b + 2)), j -> coalesce(get(m, j).pos0 = '動詞' and get(m, j).dict_form in {packs.SMELL_VERBS}, false)), 0)"
    excerpt = "substring(t.raw, m[greatest(x.a - 3, 0)].begin + 1, m[j].end - m[greatest(x.a - 3, 0)].begin)"
    one = let(verb, "j", f"if(j is null, null, {finding('t.line', 'inanimate_subject_morph', excerpt, quoted('info'), 'm[j].dict_form')})")
    own = let("t.morphemes", "m", f"if(size(m) < 3, {NONE}, filter(transform(filter({apart}, x -> coalesce(get(m, x.b + 1).pos0 = '助詞' and get(m, x.b + 1).surface in ('が', 'は'), false)), x -> {one}), y -> y is not null))")
    return f"flatten(transform(tokens, t -> {own}))"


#: In the order in which findings of one line are listed.
SURFACE: dict[str, Detector] = {
    "forbidden_phrase": forbidden_phrases,
    "translationese": calques,
    "antithesis_repetition": antithesis,
    "low_sentence_variance": low_variance,
    "paragraph_lead_conjunction": paragraph_leads,
    "uniform_paragraph_structure": uniform_paragraphs,
    "english_syntax_inanimate_subject": inanimate_subjects,
    "english_syntax_cleft_because": cleft_because,
    "high_bold_density": bold_density,
    "high_bullet_ratio": bullet_ratio,
    "boilerplate_heading": boilerplate_headings,
    "numbered_phase_structure": numbered_phases,
    "high_emoji_symbol_density": emoji_density,
}
MORPHEMES: dict[str, Detector] = {
    "nominal_ending": no_nominal_ending,
    "translationese_morph": translationese_morphemes,
    "low_burstiness": low_burstiness,
    "high_length_autocorrelation": autocorrelation,
    "repeated_sentence_lead": repeated_leads,
    "repeated_syntax_template": repeated_templates,
    "low_lexical_diversity": lexical_diversity,
    "low_specificity": low_specificity,
    "inanimate_subject_morph": inanimate_morphemes,
}
