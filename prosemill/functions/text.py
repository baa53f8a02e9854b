"""Text columns: Unicode-aware trimming, Markdown masking, lines, sentences, paragraphs.

A document stays one row. Its lines, sentences and paragraphs are array columns
built by higher-order functions, so everything up to the findings is a narrow
stage without a shuffle. Only Markdown masking, whose state runs from line to
line, is an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "struct<no:int,raw:string,masked:string>"
#: The sentence delimiters of Japanese text.
JA_DELIMITERS = "[。！？\n]"
LATIN_DELIMITERS = "[.!?\n]"
#: What `(?U)\\s` matches, as escapes of a SQL literal; trimmed from the ends only, where a regular expression reads the whole text.
WHITE = "".join(f"\\u{c:04X}" for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def ustrip(sql: str) -> str:
    """SQL: strip Unicode white space from both ends."""
    return f"trim(BOTH '{WHITE}' FROM {sql})"


def shown(sql: str) -> str:
    """SQL: whether there is more than white space, most often told by the first character behind spaces."""
    return f"(ascii(ltrim({sql})) not in (0, {', '.join(str(int(c, 16)) for c in WHITE.split('\\u') if c)}) or {ustrip(sql)} <> '')"


def inked(sql: str) -> str:
    """SQL: whether the first character of a text is surely no white space."""
    return f"(ascii({sql}) between 33 and 126 or ascii({sql}) between 161 and 5759 or ascii({sql}) > 12288)"


def stripped(array: str) -> str:
    """SQL: texts of an array without Unicode white space at their ends; those with none but spaces there, as most are, are told by two characters."""
    return f"transform(transform({array}, x -> trim(x)), x -> if({inked('x')} and {inked('substring(x, -1)')}, x, {ustrip('x')}))"


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spans(text: str, pattern: str) -> str:
    """SQL: array of (start from 0, hit) for every match of a pattern that matches no empty string.

    One fold over the matches carries the place reached by the pieces before.
    """
    kind = "array<struct<start:int,hit:string>>"
    fold = f"aggregate(sequence(0, size(h) - 1), struct(0 as at, cast(array() as {kind}) as out), (a, k) -> struct(a.at + length(g[k]) + length(h[k]) as at, array_append(a.out, struct(a.at + length(g[k]) as start, h[k] as hit)) as out)).out"
    body = let(f"split({text}, {quoted(pattern)})", "g", f"cast({fold} as {kind})")
    return let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", "h", f"if(size(h) = 0, cast(array() as {kind}), {body})")


def normal_lines(text: Column) -> Column:
    """All line ends as line feeds, as numbered lines are split."""
    other = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    return F.when(_has(text, *other), F.regexp_replace(text, f"\r\n|[{other}]", "\n")).otherwise(text)


def _has(text: Column, *parts: str) -> Column:
    """Whether any of the strings occurs: a search of bytes, where a regular expression decodes the whole text first."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts])


def mask_comments(text: Column) -> Column:
    """HTML comments as spaces of the same length; one that never closes runs to the end."""
    pattern = r"(?s)<!-->|<!--->|<!--.*?-->|<!--.*\z"
    return F.when(_has(text, "<!--"), _refilled(text, pattern, lambda hit: F.regexp_replace(hit, r"[^\n]", " "))).otherwise(text)


def _refilled(text: Column, pattern: str, fill) -> Column:
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(fill(h), F.lit(""))))
    return F.array_join(pairs, "")


def blank_inline_code(line: Column) -> Column:
    """Code spans and link targets as spaces of the same length."""
    out = _refilled(line, r"``(?:[^`\n]|`(?!`))+``|`[^`\n]+`", lambda h: F.repeat(F.lit(" "), F.length(h)))
    return _refilled(out, r"(?<=\]\()[^)]*(?=\))", lambda h: F.repeat(F.lit(" "), F.length(h)))


#: What a text without any Markdown structure or code does not have; such texts need not be masked.
MARKS = ("`", "~~~", "<!--", "](")
STRUCTURE = r"(?m)^\s*(?:#{1,6}(?:\s|$)|[-*+](?:\s|$)|\d+[.)](?:\s|$)|>|\||---|[\s:|-]*\|)"


def mask_markdown(text: Column) -> Column:
    """``text`` with what is no prose in Markdown blanked; only texts with any of it go through the Arrow function."""
    return F.coalesce(markdown_masker()(F.when(_has(text, *MARKS) | text.rlike(STRUCTURE), text)), text)


#: Characters of texts that are masked before they are handed back.
MASKED_PIECE = 1 << 20


def markdown_masker():
    """An Arrow function that blanks what is no prose in Markdown, keeping line numbers and offsets."""

    def mask(text: str) -> str:
        import re

        fence = re.compile(r"\s*(`{3,}|~{3,})(.*)", re.S)
        rule = re.compile(r"---\s*\Z")
        structure = re.compile(r"\s*#{1,6}(?:\s|\Z)|\s*(?:[-*+]|\d+[.)])(?:\s|\Z)|\s*>|\s*\|.*\||\s*\|?[\s:|-]+\|[\s:|-]*\|?\s*\Z")
        code = re.compile(r"``(?:[^`\n]|`(?!`))+``|`[^`\n]+`")
        target = re.compile(r"(?<=\]\()[^)]*(?=\))")
        blank = lambda m: " " * len(m[0])

        def lines() -> Iterator[str]:
            header = comment = False
            opened = ""
            for k, line in enumerate(text.split("\n")):
                if header or (k == 0 and rule.match(line)):
                    header = k == 0 or not rule.match(line)
                    yield ""
                    continue
                m = fence.match(line)
                if m:
                    if not opened:
                        opened = m[1]
                    elif m[1].startswith(opened) and not m[2].strip():
                        opened = ""
                if m or opened:
                    yield ""
                    continue
                out, at = "", 0
                while at < len(line):
                    edge = line.find("-->" if comment else "<!--", at)
                    stop = len(line) if edge < 0 else edge + 3 if comment else edge
                    out += " " * (stop - at) if comment else line[at:stop]
                    comment, at = (comment if edge < 0 else not comment), stop
                yield "" if structure.match(out) else target.sub(blank, code.sub(blank, out))

        return "\n".join(lines())

    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = 0
            while at < len(batch):
                out, size = [], 0
                while at < len(batch) and size < MASKED_PIECE:
                    text = batch[at].as_py()
                    out.append(None if text is None else mask(text))
                    size += len(text or "")
                    at += 1
                yield pa.array(out, pa.string())

    # projections that read the result inside lambdas must not take the call in
    return F.arrow_udf(masked, "string").asNondeterministic()


def lines_of(raw: str, masked: str) -> str:
    """SQL: numbered lines with both texts; an empty last line is dropped."""
    cut = lambda c: let(f"split({c}, '\\n')", "p", "if(element_at(p, -1) = '', slice(p, 1, size(p) - 1), p)")
    # a text that is not masked is split once
    same = f"transform({cut(raw)}, (x, i) -> struct(i + 1 as no, x as raw, x as masked))"
    other = let(f"struct({cut(raw)} as r, {cut(masked)} as m)", "q", "transform(q.r, (x, i) -> struct(i + 1 as no, x as raw, coalesce(get(q.m, i), '') as masked))")
    pair = f"if({raw} = {masked}, {same}, {other})"
    return f"cast({pair} as array<{LINE}>)"


def sentences_of(lines: str, delimiters: str = JA_DELIMITERS) -> str:
    """SQL: (line, masked, raw) of every piece between delimiters that is not blank; the raw piece has the masked offsets."""
    kind = "struct<line:int,masked:string,raw:string>"
    # where nothing is masked both texts of a piece are one; elsewhere a fold carries the place
    piece = "named_struct('line', l.no, 'masked', x, 'raw', x)"
    plain = f"transform(filter({stripped('p')}, x -> x <> ''), x -> {piece})"
    raw = "if(length(l.raw) >= a.at + length(x), substring(l.raw, a.at + 1, length(x)), x)"
    fold = f"aggregate(p, struct(0 as at, cast(array() as array<{kind}>) as out), (a, x) -> struct(a.at + length(x) + 1 as at, array_append(a.out, cast(struct(l.no as line, {ustrip('x')} as masked, {ustrip(raw)} as raw) as {kind})) as out)).out"
    own = let(f"split(l.masked, {quoted(delimiters)})", "p", f"if(l.raw = l.masked, {plain}, filter({fold}, s -> s.masked <> ''))")
    return f"flatten(transform({lines}, l -> {own}))"


def paragraphs_of(lines: str) -> str:
    """SQL: maximal runs of lines that are not blank."""
    blank = f"filter(transform({lines}, l -> if({shown('l.masked')}, null, l.no)), x -> x is not null)"
    edges = let(f"concat(array(0), {blank}, array(size({lines}) + 1))", "b", f"transform(sequence(0, size(b) - 2), i -> slice({lines}, b[i] + 1, greatest(b[i + 1] - b[i] - 1, 0)))")
    return f"filter({edges}, p -> size(p) > 0)"


def heading_level(line: str) -> str:
    """SQL: level of an ATX heading, null for other lines."""
    return f"nullif(length(regexp_extract({line}, '^(?U)\\\\s*(#{{1,6}})(?=\\\\s|$)', 1)), 0)"


def heading_text(line: str) -> str:
    """SQL: text of an ATX heading; a closing run of # goes only after white space."""
    inner = f"regexp_replace({line}, '^(?U)\\\\s*#{{1,6}}(?=\\\\s|$)', '')"
    return ustrip(f"regexp_replace({inner}, '(?U)\\\\s+#+\\\\s*$', '')")
