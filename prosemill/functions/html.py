"""HTML to Markdown-like text, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape_entities(text: Column) -> Column:
    """Five named references in a fixed order (nbsp, amp, lt, gt, quot), then numeric ones; so `&amp;lt;` becomes `<`."""
    for name, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    # a reference is decoded from its code point's UTF-32 bytes
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def char(hit: Column) -> Column:
        body = F.substring(hit, F.lit(3), F.length(hit) - 3)
        code = F.when(body.rlike("^[xX]"), F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(hit)

    return _replaced(text, pattern, 0, char)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _replaced(text: Column, pattern: str, group: int, fill) -> Column:
    """``text`` with what ``fill`` makes of a group of every match in its place."""
    return _bound(text, lambda x: F.array_join(F.zip_with(F.split(x, pattern), F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), lambda g, h: F.concat(g, F.coalesce(fill(h), F.lit("")))), ""))


#: A heading, and elements whose content is no text.
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"
UNREAD = r"(?is)<(script|style|noscript)[^>]*>.*?</\1>"


def convert_headings(html: Column) -> Column:
    """`<h1>` to `<h6>` as Markdown headings between blank lines, their text decoded; an empty heading as nothing."""

    def heading(hit: Column) -> Column:
        inner = unescape_entities(F.regexp_replace(F.regexp_extract(hit, HEADING, 2), r"(?s)<[^>]+>", ""))
        marks = F.repeat(F.lit("#"), F.substring(hit, 3, 1).cast("int"))
        return _bound(F.trim(F.regexp_replace(inner, r"(?U)\s+", " ")), lambda w: F.when(w != "", F.concat(F.lit("\n\n"), marks, F.lit(" "), w, F.lit("\n\n"))).otherwise(""))

    return _replaced(html, HEADING, 0, heading)


def strip_tags(html: Column) -> Column:
    """Text of a page part: scripts gone, headings kept, breaks and paragraphs as lines, non-blank lines joined by blank ones."""
    html = convert_headings(F.regexp_replace(html, UNREAD, ""))
    html = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    html = F.regexp_replace(html, r"(?i)</p>", "\n\n")
    text = unescape_entities(F.regexp_replace(html, r"(?s)<[^>]+>", ""))
    trimmed = F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n\n")


def title_of(html: Column) -> Column:
    return F.nullif(F.trim(unescape_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def _first(html: Column, *patterns: str) -> Column:
    """What the first pattern that is found encloses, be it nothing; null where none is found."""
    return F.coalesce(*[F.get(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.lit(0)) for p in patterns])


#: Body patterns of two known site layouts, and of any page.
SITE_BODY = {"note": r"(?is)<div[^>]*class=\"[^\"]*note-common-styles__textnote-body[^\"]*\"[^>]*>(.*?)</div>\s*</div>", "zenn": r"(?is)<div[^>]*class=\"[^\"]*znc[^\"]*\"[^>]*>(.*?)</div>\s*</(?:section|article)>"}
ARTICLE = r"(?is)<article[^>]*>(.*?)</article>"
MAIN = r"(?is)<main[^>]*>(.*?)</main>"


def extract_generic(html: Column) -> Column:
    """Text of the article, else of the main part, else of the page."""
    return strip_tags(F.coalesce(_first(html, ARTICLE, MAIN), html))


def extract_body(url: Column, html: Column, least: int = 200) -> tuple[Column, Column]:
    """(text, method): a known site's layout where it gives more than ``least`` characters, else the generic way."""
    made = F.struct(extract_generic(html).alias("text"), F.lit("generic").alias("method"))
    for site, host in (("zenn", "zenn.dev"), ("note", "note.com")):
        body = F.when(url.contains(host), F.coalesce(_first(html, SITE_BODY[site], ARTICLE), F.lit("")))
        made = _bound(strip_tags(body), _longer(site, made, least))
    return made["text"], made["method"]


def _longer(site: str, other: Column, least: int):
    return lambda own: F.when(F.length(own) > least, F.struct(own.alias("text"), F.lit(site).alias("method"))).otherwise(other)


#: Charset names and the decoders that read them here.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}


def decode_html(content: Column, header: Column, sniffed: int = 2048) -> tuple[Column, Column]:
    """(text, charset) of page bytes: the charset of the content type header, else one named in the first bytes, else UTF-8.

    A charset without a decoder gives a null text and its name, for an outside decoder.
    """
    named = r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)"
    start = F.decode(F.substring(content, 1, sniffed), "ISO-8859-1")
    found = F.lower(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(header, F.lit("")), named, 1), F.lit("")), F.nullif(F.regexp_extract(start, named, 1), F.lit("")), F.lit("utf-8")))
    text = F.lit(None).cast("string")
    for name, decoder in CHARSETS.items():
        text = F.when(found == name, F.decode(content, decoder) if decoder != "UTF-8" else F.make_valid_utf8(content.cast("string"))).otherwise(text)
    return text, found
