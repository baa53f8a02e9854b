"""Main text of HTML pages with a site style tree.

The document trees of all pages of a host are merged by branch (tag, classes and
role from the body down). Of every merged branch two things are measured over the
host's pages: the entropy of its presentation (the sequences of child tags) and
the entropy of its content (the mean surprisal of its text blocks: how far each is
spread over the pages). Their weighted sum, drawn towards 1 while the host has
shown few pages, is the branch's importance. A branch of low importance is
removed from each page of the host. The branch that holds most of the host's
different text is its home: it and what is around it are never removed, and
inside it only branches of very low importance are. A page of which the tree would
leave nothing, as copies of one text in a rarer layout, is left to names alone.

Names come after the tree. What the tree leaves is removed if its tag, or a whole
class name, id or role, says that it is no main text (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments): a host of one page has no
statistics, and comments are as various as articles. A named branch stays if the
tree found it to be the host's home, if it holds the page's article, or (unless
it is named for comments, menus or adverts) if it holds most of the text of a
page without one: it is a wrapper named after what stands beside it. Elements
that are never rendered as text (scripts, styles, form controls) always go.

The statistics never judge one paragraph, heading, item or cell: those belong to
the branch around them, so a passage that many articles share stays.

Scale: pass one emits one row per page and merged branch or text hash, and is
summed by host, branch and hash with partial aggregation, so a host that holds a
third of all pages is pre-aggregated in every task. What a page needs back is its
host's list of unimportant branches, a table that is broadcast only when its
counted size is small and joined otherwise; hot hosts can be split there. A page
is read in time linear in its length: elements below ``MAX_DEPTH`` open ones are
siblings, as in browsers, and below ``TREE_DEPTH`` they are judged with the
branch above them.

Defined results: a null or empty html, or a page without text, gives an empty
text of 0 characters; unclosed and stray tags are read as browsers do for
paragraphs and list items; a tag that the page ends in is no text; repeated rows
repeat; a null id stays null; a null url is host ''; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import drop, written
from .urlfilter import host_of

#: Elements that are never rendered as text of a page.
UNRENDERED = frozenset("head script style noscript template button select option textarea input iframe object embed svg canvas audio video".split())
#: Elements that HTML marks as no main text.
NAMED_TAGS = frozenset("nav aside form dialog menu footer".split())
#: Words of class, id or role names that mark a branch as no main text.
MARKED = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored banner promo cookie cookies consent gdpr notice notices popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus related share sharing social subscribe newsletter signup login search pagination pager widget widgets contentinfo complementary".split())
#: Words that may stand beside those in one name.
BESIDE = frozenset("site page global main top bottom left right primary secondary box bar area list items item block container wrapper wrap inner outer section slot unit row col links buttons icons thread form field posts articles stories reader readers user users the of and".split())
#: Marks that a large share of the text does not turn into a wrapper.
FIRM = frozenset("comment comments disqus nav navbar navigation menu ad ads advert adverts advertisement adsense".split())
#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks that are judged with the branch around them.
PARTS = frozenset("article body caption dd dt h1 h2 h3 h4 h5 h6 hr html li main p summary tbody td tfoot th thead tr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of the same kind first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div footer form header main nav ol section table ul".split())
_CONTENT = frozenset("article main".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_WORDS = re.compile(r"[^a-z0-9]+")
#: Open elements of a page; further ones are siblings.
MAX_DEPTH = 512
#: Levels of the style tree; deeper branches are judged with the one above them.
TREE_DEPTH = 64


@dataclass(frozen=True)
class TreeRules:
    #: Branches of lower importance are removed outside and inside the host's home.
    min_importance: float = 0.7
    min_inside: float = 0.3
    #: Pages a merged branch needs before its statistics count, and pages of importance 1 that are added to them.
    min_pages: int = 3
    prior_pages: float = 5.0
    #: Weight of content against presentation.
    content_share: float = 0.9
    #: Broadcast the unimportant branches up to so many; join them beyond.
    broadcast_rows: int = 200_000
    #: Whether names count.
    names: bool = True


class Node:
    """An element of a page; ``key`` names its branch in the host's tree."""

    __slots__ = ("tag", "parent", "key", "level", "at", "content", "block", "hidden", "words", "kids")

    def __init__(self, tag: str, parent: Node | None, at: int, marks: dict[str, str]):
        self.tag, self.parent, self.at = tag, parent, at
        self.kids: list[str] = []
        self.words: frozenset[str] = frozenset()
        self.block = tag in BLOCKS
        if parent is None:
            self.key, self.level, self.content, self.hidden = 0, 0, False, False
            return
        role = marks.get("role", "").strip()
        self.content = parent.content or tag in _CONTENT or role in _CONTENT
        self.hidden = parent.hidden or tag in UNRENDERED
        if tag in ("html", "body") or parent.level >= TREE_DEPTH:
            self.key, self.level = parent.key, parent.level
        else:
            self.key = xxhash.xxh64_intdigest(f"{parent.key}/{tag}.{'.'.join(sorted(set(marks.get('class', '').split())))}.{role}") - (1 << 63)
            self.level = parent.level + 1
        if tag in _CONTENT or tag in ("html", "body"):
            return
        if tag in NAMED_TAGS or (tag == "header" and not parent.content):
            self.words = frozenset((tag,))
        if marks:
            self.words |= {w for name in " ".join(marks.values()).split() for w in _marking(name)}

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


def _marking(name: str) -> frozenset[str]:
    """The marking words of a whole class name, id or role: none if any word of it stands for something else."""
    words = [w for w in _WORDS.split(name) if w and not w.isdigit()]
    found = MARKED.intersection(words)
    return found if found and all(w in MARKED or w in BESIDE for w in words) else frozenset()


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at ``at`` ends (behind its `>`), or -1; quoted values may hold a `>`."""
    while at <= last[">"]:
        m = _STOP.search(html, at)
        if m is None:
            return -1
        at = m.end()
        q = m[0]
        if q == ">":
            return at
        if at <= last[q] and html[max(at - 9, 0) : at - 1].rstrip().endswith("="):
            at = html.find(q, at) + 1
    return -1


class Page:
    """Elements of a page in order, and its text blocks: lists of (element, raw text)."""

    def __init__(self, html: str):
        self.root = Node("", None, 0, {})
        self.nodes = [self.root]
        self.blocks: list[list[tuple[Node, str]]] = []
        self._open: list[tuple[Node, str]] = []
        self._read(html)
        self._break()

    def _break(self) -> None:
        if self._open:
            self.blocks.append(self._open)
            self._open = []

    def _read(self, html: str) -> None:
        stack = [self.root]
        last = {c: html.rfind(c) for c in ">\"'"}
        at, n = 0, len(html)

        def close(k: int) -> None:
            if any(x.block for x in stack[k:]):
                self._break()
            del stack[k:]

        def text(a: int, e: int) -> None:
            if a < e and not stack[-1].hidden:
                self._open.append((stack[-1], html[a:e]))

        while at < n:
            lt = html.find("<", at)
            if lt == -1:
                text(at, n)
                return
            following = html[lt + 1 : lt + 2]
            if following in ("!", "?"):
                text(at, lt)
                mark = "-->" if html.startswith("<!--", lt) else "]]>" if html.startswith("<![CDATA[", lt) else ">"
                end = html.find(mark, lt + (4 if mark == "-->" else 2))
                at = end + len(mark) if end != -1 else n
                continue
            closing = following == "/"
            name = _NAME.match(html, lt + 1 + closing)
            if name is None:
                text(at, lt + 1)  # no tag
                at = lt + 1
                continue
            text(at, lt)
            at = _tag_end(html, name.end(), last)
            if at == -1:
                return
            tag = name[0].lower()
            if closing:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag or (tag not in _SCOPE and stack[k].tag in _SCOPE)), 0)
                if k and stack[k].tag == tag:
                    close(k)
                elif tag == "p":
                    self._break()
                continue
            ends = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else ())
            if ends:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ends or stack[k].tag in _SCOPE), 0)
                if k and stack[k].tag in ends:
                    close(k)
            rest = html[name.end() : at - 1]
            marks = {}
            if "=" in rest:
                for m in _ATTRIBUTE.finditer(rest):
                    marks.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
            node = Node(tag, stack[-1], lt, marks)
            up = stack[-1].kids
            if not up or up[-1] != tag:
                up.append(tag)
            self.nodes.append(node)
            if node.block:
                self._break()
            if tag == "br" and not node.hidden:
                self._open.append((stack[-1], " "))
            if tag in VOID or rest.endswith("/"):
                continue
            if tag in _RAW:
                end = _RAW[tag].search(html, at)
                at = end.end() if end else n
            elif len(stack) < MAX_DEPTH:
                stack.append(node)

    def texts(self, gone: set[Node] | None = None) -> Iterator[tuple[Node, str]]:
        """Blocks with white space collapsed, without the text of elements in ``gone``, and the element each begins in."""
        for block in self.blocks:
            parts = [(node, raw) for node, raw in block if node not in gone] if gone else block
            text = " ".join(unescape("".join([raw for _, raw in parts])).split())
            if text:
                yield next((node for node, raw in parts if not raw.isspace()), parts[0][0]), text

    def wrappers(self) -> set[Node]:
        """Named branches that hold the page's article, or most of the text of a page without one."""
        total, homes, inside = 0, Counter(), Counter()
        seen: dict[Node, tuple[tuple[Node, ...], tuple[Node, ...] | None]] = {}

        def marks(node: Node) -> tuple[tuple[Node, ...], tuple[Node, ...] | None]:
            """Named branches around the element, and those around the outermost article it is in."""
            todo = []
            while node not in seen and node.parent is not None:
                todo.append(node)
                node = node.parent
            own = seen.setdefault(node, ((), None))
            for x in reversed(todo):
                around = (*own[0], x) if x.words else own[0]
                own = seen[x] = around, own[1] if own[1] is not None else around if x.content else None
            return own

        for block in self.blocks:
            for node, raw in block:
                n = len("".join(raw.split()))
                total += n
                around, home = marks(node)
                if home is not None:
                    homes[home] += n
                for x in around:
                    inside[x] += n
        if +homes:
            return set() if homes[()] else set(homes.most_common(1)[0][0])
        return {x for x, n in inside.items() if 2 * n > total and not x.words & FIRM and x.tag not in NAMED_TAGS - {"form"}}

    def judged(self, low: frozenset[int], homes: frozenset[int], names: bool = True) -> tuple[set[Node], set[Node]]:
        """Elements inside branches that the tree removes, and inside those that names do; a tree that leaves a page nothing is not asked."""
        kept = self.wrappers() if names and any(x.words for x in self.nodes) else set()
        by_tree: set[Node] = set()
        by_name: set[Node] = set()
        for x in self.nodes[1:]:
            if x.parent in by_tree or (x.key in low and x.block and x.tag not in PARTS):
                by_tree.add(x)
            elif x.parent in by_name or (names and x.words and x not in kept and x.key not in homes):
                by_name.add(x)
        if by_tree and not any(not raw.isspace() for block in self.blocks for x, raw in block if x not in by_tree and x not in by_name):
            return self.judged(frozenset(), homes, names)
        return by_tree, by_name

    def style(self) -> Iterator[tuple[int, str, int, int, list[int] | None]]:
        """Of every branch (key, "s", hash of its sequences of child tags, level, keys around it); of every text block (key, "t", hash, characters, null)."""
        shapes: dict[int, tuple[Node, set[str]]] = {}
        for x in self.nodes:
            if not x.hidden:
                shapes.setdefault(x.key, (x, set()))[1].add(" ".join(x.kids))
        for key, (x, found) in shapes.items():
            yield key, "s", _hashed("|".join(sorted(found))), x.level, list(dict.fromkeys(y.key for y in x.above()))
        for key, h, size in {(x.key, _hashed(text), len(text)) for x, text in self.texts()}:
            yield key, "t", h, size, None


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


_ROWS = pa.schema([("host", pa.string()), ("key", pa.int64()), ("kind", pa.string()), ("hash", pa.int64()), ("size", pa.int64()), ("above", pa.list_(pa.int64()))])


def style_tree(pages: DataFrame, rules: TreeRules) -> DataFrame:
    """Every merged branch of every host, from (host, html): ``m`` pages, ``importance``, ``mass`` (its share of the host's different text), ``home`` and ``inside`` (the home)."""

    def run(batches):
        for b in T.chunks(batches, "html"):
            rows = [(host, *row) for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) for row in Page(html or "").style()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_ROWS), _ROWS, strict=True)], schema=_ROWS)

    seen = pages.mapInArrow(run, "host string, key bigint, kind string, hash bigint, size bigint, above array<bigint>").groupBy("host", "key", "kind", "hash").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.first("above").alias("above"))
    style, text = F.col("kind") == "s", F.col("kind") == "t"
    nodes = seen.groupBy("host", "key").agg(
        F.sum(F.when(style, F.col("n"))).alias("m"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("mlog"),
        F.max(F.when(style, F.col("size"))).alias("level"),
        F.max(F.when(style, F.col("above"))).alias("above"),
        F.sum(F.when(text, F.col("n"))).alias("blocks"),
        F.sum(F.when(text, F.col("n") * F.log("n"))).alias("blog"),
        F.sum(F.when(text, F.col("size"))).alias("chars"),
    )
    own = F.struct("m", "mlog", "level", "above")
    spread = nodes.select("host", F.explode("above").alias("branch"), "blocks", "blog", "chars", F.when(F.col("branch") == F.col("key"), own).alias("own"))
    tree = spread.groupBy("host", F.col("branch").alias("key")).agg(F.max("own").alias("own"), F.sum("blocks").alias("blocks"), F.sum("blog").alias("blog"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).select("host", "key", "own.*", "blocks", "blog", "chars")
    tree = written(tree, "tree")  # read three times below
    whole = tree.filter("key = 0").select("host", F.col("chars").alias("whole"))
    tree = tree.join(whole, "host").withColumn("mass", F.coalesce(F.try_divide("chars", "whole"), F.lit(0.0)))
    homes = tree.filter("mass > 0.5").groupBy("host").agg(F.max_by("key", F.struct("level", "key")).alias("deepest"))
    m, g = F.col("m"), rules.content_share
    presentation = F.greatest(F.log(m) - F.col("mlog") / m, F.lit(0.0)) / F.log(m)
    content = 1 - F.try_divide("blog", F.col("blocks") * F.log(m))
    raw = F.when(m <= 1, 1.0).otherwise(F.when(content.isNull(), presentation).otherwise((1 - g) * presentation + g * content))
    k = rules.prior_pages
    return tree.join(homes, "host", "left").select(
        "host", "key", "m", "level", ((m * raw + k) / (m + k)).alias("importance"), "mass", (F.col("mass") > 0.5).alias("home"), F.coalesce(F.array_contains("above", F.col("deepest")) & (F.col("key") != F.col("deepest")), F.lit(False)).alias("inside")
    )


def low_importance(tree: DataFrame, rules: TreeRules) -> DataFrame:
    """From ``style_tree``: ``host`` with its unimportant branches (``keys``) and those that hold most of its text (``homes``)."""
    limit = F.when(F.col("inside"), rules.min_inside).otherwise(rules.min_importance)
    low = ~F.col("home") & (F.col("m") >= rules.min_pages) & (F.col("importance") < limit)
    home = F.col("home") & (F.col("m") >= rules.min_pages) & (F.col("key") != 0)
    return tree.filter(low | home).groupBy("host").agg(F.collect_list(F.when(low, F.col("key"))).alias("keys"), F.collect_list(F.when(home, F.col("key"))).alias("homes"))


def main_text(html: str | None, low: frozenset[int] = frozenset(), homes: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The blocks of a page that remain, joined by line feeds."""
    page = Page(html or "")
    by_tree, by_name = page.judged(low, homes, names)
    return "\n".join(text for _, text in page.texts(by_tree | by_name))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: TreeRules | None = None) -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars``; then ``tree_chars`` and ``name_chars``, the characters that the tree and that names removed."""
    rules = rules or TreeRules()
    T.prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    tree = style_tree(rows.select("host", "html"), rules)
    low = written(low_importance(tree, rules), "style")
    drop(tree)
    small = low.select(F.coalesce(F.sum(F.size("keys") + F.size("homes")), F.lit(0))).first()[0] <= rules.broadcast_rows
    joined = rows.join(F.broadcast(low) if small else low, "host", "left").select("__id", "__url", "html", "keys", "homes")

    def run(batches):
        for b in T.chunks(batches, "html"):
            found: dict[str, list] = {"text": [], "n_chars": [], "tree_chars": [], "name_chars": []}
            for html, keys, homes in zip(*(b.column(c).to_pylist() for c in ("html", "keys", "homes")), strict=True):
                page = Page(html or "")
                by_tree, by_name = page.judged(frozenset(keys or ()), frozenset(homes or ()), rules.names)
                text = "\n".join(t for _, t in page.texts(by_tree | by_name))
                found["text"].append(text)
                found["n_chars"].append(len(text))
                for name, gone in (("tree_chars", by_tree), ("name_chars", by_name)):
                    found[name].append(sum(len("".join(raw.split())) for block in page.blocks for node, raw in block if node in gone) if gone else 0)
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__url"), pa.array(found["text"], pa.string()), *(pa.array(found[c], pa.int64()) for c in ("n_chars", "tree_chars", "name_chars"))], names=["__id", "__url", *found])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("__id", "__url")}
    out = joined.mapInArrow(run, f"__id {kinds['__id']}, __url {kinds['__url']}, text string, n_chars bigint, tree_chars bigint, name_chars bigint")
    return out.withColumnRenamed("__id", id_col).withColumnRenamed("__url", url_col)
