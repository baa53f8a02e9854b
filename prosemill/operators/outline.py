"""Document outlines, heading statistics and term inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading_level, heading_text, let, quoted, spans, ustrip
from ..rules.packs import TEMPLATE_HEADINGS, Pack
from .detectors import words
from .morphemes import script_splitter

_LIST = "^(?U)\\s*([-*+]|\\d+[.)])(\\s|$)"
_QUOTE = "^(?U)\\s*>"
_TABLE = "^(?U)\\s*\\|.*\\|"
_FENCE = "^(?U)\\s*(`{3,}|~{3,})"


def _fences() -> str:
    """SQL: (a, b), the lines of each fence and of what closes it: a marker of the same kind, no shorter, with nothing behind it."""
    mark = "struct(l.no as no, regexp_extract(l.raw, '^(?U)\\\\s*(`{3,}|~{3,})', 1) as mark, regexp_replace(l.raw, '^(?U)\\\\s*(`{3,}|~{3,})', '') as rest)"
    close = "struct('' as opened, 0 as a, array_append(f.out, struct(f.a as a, m.no as b)) as out)"
    step = f"if(f.opened = '', struct(m.mark as opened, m.no as a, f.out as out), if(startswith(m.mark, f.opened) and {ustrip('m.rest')} = '', {close}, f))"
    end = "if(f.opened = '', f.out, array_append(f.out, struct(f.a as a, size(lines) + 1 as b)))"
    return f"aggregate(transform(filter(lines, l -> l.raw rlike {quoted(_FENCE)}), l -> {mark}), struct('' as opened, 0 as a, cast(array() as array<struct<a:int,b:int>>) as out), (f, m) -> {step}, f -> {end})"


def outline(prepared: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, line, kind (heading, lead or bullets), level and text, one row per entry.

    A block is a run of lines of one kind; a blank line or another kind ends it.
    Lines inside fences and front matter, which masking empties, are skipped. An
    indented line goes on with a list, and is prose elsewhere.
    """
    # one letter a line; a fenced line or front matter is empty when masked, yet none of the structures masking empties
    kind = f"""case when {ustrip('l.raw')} = '' then 'B'
      when {heading_level('l.raw')} is not null then 'H'
      when l.raw rlike {quoted(_LIST)} then 'L'
      when l.raw rlike {quoted(_QUOTE)} or l.raw rlike {quoted(_TABLE)} then 'S'
      when l.masked = '' or l.raw rlike {quoted(_FENCE)} then 'S'
      when {ustrip('l.masked')} = '' then 'B'
      when l.raw rlike '^(?U)\\\\s' then 'I' else 'P' end"""
    letters = f"array_join(transform(lines, l -> if(exists(fences, f -> l.no > f.a and l.no < f.b), 'S', {kind})), '')"
    out = prepared.withColumn("fences", F.expr(_fences())).withColumn("kinds", F.expr(f"translate(regexp_replace({letters}, '(?<=L)I|(?!^)\\\\GI', 'M'), 'I', 'P')"))
    first = "k[i] in ('H', 'P', 'L') and (k[i] = 'H' or coalesce(translate(get(k, i - 1), 'M', 'L'), '') <> k[i])"
    starts = let("split(kinds, '')", "k", f"transform(filter(sequence(0, size(lines) - 1), i -> {first}), i -> struct(k[i] as kind, i as i, lines[i] as x))")
    lead = ustrip(f"split(y.x.masked, {quoted(pack.delimiters)})[0]")
    bullets = "length(replace(regexp_extract(substring(kinds, y.i + 1), '^[LM]+', 0), 'M', ''))"
    entry = f"struct(y.x.no as line, case y.kind when 'H' then 'heading' when 'P' then 'lead' else 'bullets' end as kind, if(y.kind = 'H', {heading_level('y.x.raw')}, null) as level, case y.kind when 'H' then {heading_text('y.x.raw')} when 'P' then {lead} else concat('(', {bullets}, ' items)') end as text)"
    rows = out.filter("size(lines) > 0").select("doc_id", F.inline(F.expr(f"transform({starts}, y -> {entry})")))
    return rows.filter("kind <> 'lead' or text <> ''")


def headings(outlined: DataFrame) -> DataFrame:
    """The headings with their length, template word and structural pattern."""
    bare = "lower(regexp_replace(text, '^[0-9０-９]+[.．、)）:：]?(?U)\\\\s*', ''))"
    out = outlined.filter("kind = 'heading'")
    template = F.expr(f"get(filter({words(TEMPLATE_HEADINGS)}, w -> startswith({bare}, w)), 0)")
    pattern = F.expr("case when text rlike '^[0-9０-９]+[.．、)）:：]|^第[0-9０-９一二三四五六七八九十]+' then 'numbered' when text rlike '^[【「『\\\\[]' then 'bracketed' when text rlike 'とは[?？]?$' then 'definition' end")
    return out.select("doc_id", "line", "level", "text", F.length("text").alias("length"), template.alias("template"), pattern.alias("pattern"))


def heading_grammar(tokenised: DataFrame) -> DataFrame:
    """From headings with a ``morphemes`` array: content parts of speech in order, and whether the heading ends in a noun."""
    content = "filter(morphemes, m -> m.pos0 in ('名詞', '動詞', '形容詞', '副詞'))"
    last = "element_at(filter(morphemes, m -> m.pos0 not in ('補助記号', '空白')), -1)"
    return tokenised.select("doc_id", "line", "level", F.expr(f"array_join(transform({content}, m -> m.pos0), '/')").alias("signature"), F.expr(f"coalesce(if(size(morphemes) > 0, {last}.pos0 = '名詞', false), false)").alias("nominal"))


def signature_shares(grammar: DataFrame) -> DataFrame:
    """Per document and level and over all levels: share of the commonest signature and of nominal endings among all headings."""
    counts = grammar.groupBy("doc_id", "level", "signature").agg(F.count("*").alias("c"), F.count_if("nominal").alias("nominal"))
    by_level = counts.groupBy("doc_id", "level").agg((F.max("c") / F.sum("c")).alias("dominant_share"), (F.sum("nominal") / F.sum("c")).alias("nominal_ratio"))
    whole = counts.groupBy("doc_id", "signature").agg(F.sum("c").alias("c"), F.sum("nominal").alias("nominal"))
    overall = whole.groupBy("doc_id").agg((F.max("c") / F.sum("c")).alias("dominant_share"), (F.sum("nominal") / F.sum("c")).alias("nominal_ratio"))
    return by_level.unionByName(overall.withColumn("level", F.lit(None).cast("int")))


def heading_statistics(found: DataFrame) -> DataFrame:
    """Per document and level, and over all levels (level null): count, mean length, its variation, template hits and structural share."""
    mean = F.avg("length")
    out = found.groupingSets([[F.col("doc_id"), F.col("level")], [F.col("doc_id")]], "doc_id", "level").agg(
        F.grouping("level").alias("all_levels"),
        F.count("*").alias("n"),
        F.bround(mean, 2).alias("length_mean"),
        F.bround(F.coalesce(F.try_divide(F.stddev_pop("length"), mean), F.lit(0.0)), 3).alias("length_cv"),
        F.count("template").alias("template_hits"),
        F.bround(F.count("pattern") / F.count("*"), 3).alias("structural_ratio"),
    )
    return out


#: Words near a term that point to an explanation.
GLOSS_MARKERS = ("とは", "と呼ぶ", "という", "、つまり")


# The forms of a term.
KATAKANA = "^[ァ-ヶー]+$"
ACRONYM = "(?<![A-Za-z0-9])[A-Z]{2,}[0-9]*(?![A-Za-z0-9])"
CAPITALISED = "^[A-Z][a-zA-Z0-9]*$"
KATAKANA_LENGTH = 3
CONTEXT = 80


def term_lines() -> str:
    """SQL: the lines that terms are taken from (prose, and headings without their marks): array of (no, text)."""
    prose = f"transform(filter(lines, l -> {ustrip('l.masked')} <> ''), l -> struct(l.no as no, l.masked as text))"
    heads = f"filter(transform(split(bare, '\\n'), (x, i) -> if({heading_level('x')} is not null, struct(i + 1 as no, {heading_text('x')} as text), null)), x -> x is not null)"
    return f"concat({prose}, {heads})"


def term_inventory(prepared: DataFrame, morphemes: str = "_split[i]") -> DataFrame:
    """Per document and term, in order of first places: first line, count in the text without comments, context and a hint at a gloss.

    Terms are acronyms of capitals, runs of katakana morphemes of three or more
    characters, and runs of proper nouns and capitalised Latin words.
    ``morphemes`` is SQL for the morphemes of the line ``l`` (no, text), the one at
    ``i`` of ``term_lines``; by default lines are split by script. All of it is one narrow stage: a document's terms
    are sorted and cut in its own row, and no text is copied to its terms' rows.
    """
    rows = prepared.withColumn("_lines", F.expr(term_lines()))
    if morphemes == "_split[i]":
        rows = rows.withColumn("_split", script_splitter()(F.expr("transform(_lines, l -> l.text)")))
    kind = f"case when m.surface rlike '{KATAKANA}' then 'k' when (m.pos0 = '名詞' and m.pos1 = '固有名詞') or (length(m.surface) >= 2 and m.surface rlike '{CAPITALISED}') then 'p' end"
    push = "if(a.kind is null, a.out, array_append(a.out, struct(a.kind as kind, a.b as b, a.e as e)))"
    step = let(kind, "k", f"if(k is not null and k <=> a.kind, struct(a.kind as kind, a.b as b, m.end as e, a.out as out), struct(k as kind, m.begin as b, m.end as e, {push} as out))")
    runs = f"aggregate({morphemes}, struct(cast(null as string) as kind, 0 as b, 0 as e, cast(array() as array<struct<kind:string,b:int,e:int>>) as out), (a, m) -> {step}, a -> {push})"
    words_ = f"filter(transform({runs}, r -> struct({ustrip('substring(l.text, r.b + 1, r.e - r.b)')} as term, l.no as line, r.b as place, r.kind as kind, r.e - r.b as size)), t -> t.term <> '' and (t.kind = 'p' or t.size >= {KATAKANA_LENGTH}))"
    found = f"flatten(transform(_lines, (l, i) -> concat(transform({spans('l.text', ACRONYM)}, h -> struct(h.hit as term, l.no as line, h.start as place)), transform({words_}, t -> struct(t.term as term, t.line as line, t.place as place)))))"
    first = let(f"array_sort({found})", "f", "filter(f, (t, i) -> i = 0 or t.term <> f[i - 1].term)")
    rows = rows.withColumn("_bare", F.split("bare", "\n")).withColumn("_terms", F.expr(first))
    count = "cast((length(bare) - length(replace(bare, t.term, ''))) / length(t.term) as int)"
    before = "aggregate(slice(_bare, 1, t.line - 1), 0, (a, x) -> a + length(x) + 1)"
    at = f"if(instr(_bare[t.line - 1], t.term) > 0, {before} + instr(_bare[t.line - 1], t.term) - 1, -1)"
    context = f"if(at < 0, _bare[t.line - 1], substring(bare, greatest(at - {CONTEXT}, 0) + 1, at + length(t.term) + {CONTEXT} - greatest(at - {CONTEXT}, 0)))"
    hint = f"(at >= 0 and substring(bare, at + length(t.term) + 1, 1) in ('(', '（')) or exists({words(GLOSS_MARKERS)}, g -> contains(c, g))"
    one = let(at, "at", let(context, "c", f"struct(t.term as term, t.line as first_line, t.place as place, {count} as count, {hint} as has_gloss_hint, {ustrip('c')} as context)"))
    return rows.select("doc_id", F.inline(F.expr(f"transform(_terms, t -> {one})"))).select("doc_id", "term", "first_line", "place", "count", "has_gloss_hint", "context")
