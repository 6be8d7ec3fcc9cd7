"""Main text of web pages with removal of site templates.

A page is parsed into elements. Marked-up page furniture goes by its tag,
role, or a class name or id that is such a name or begins or ends with one
before or after a hyphen (menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles). A class, id or form tag does not
make furniture of an ``article``, a ``main``, what holds one of them or an
``h1``, or what holds more than half of the page's text (unless a ``main`` or
an ``article`` with an ``h1`` stands elsewhere, as by a short page with a long
advert). What is left of a site's template is found by
recurrence: every element subtree is hashed (tag, text and children), the
different main texts of a host that hold a subtree are counted in Spark
(copies of a page count once), and subtrees on ``min_pages`` or more and at
least ``share`` of the host's different pages are deleted, the most frequent
ones first and as long as not more than half of a page's text recurs so often. Content
may recur too (mirrored articles, quoted passages), so a subtree is not
deleted if it holds the page's own title (the first ``h1``, or a heading that
its ``title`` names) or has more than half of the page's text. Every other
element may be template, except those that only make sense with their
surroundings and go with them: inline elements beside running text, and cells
of less than ``CELL_WORDS`` words. Hosts with fewer than ``min_pages``
different pages show no recurrence and keep everything.

If ``article`` elements hold more than half of the page's text, only they
are read; else the ``main`` elements that have text (of these again only the
articles, if they hold more than half); else the whole body. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by line feeds.

Defined results: null or empty html gives an empty text; cut-off or unclosed
markup is read as far as it goes; a null or odd url is the host ""; repeated
rows get equal rows; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import durable, text_slices

MIN_PAGES = 3
#: Removal tables of up to this many rows (16 bytes each) are sent to the tasks; larger ones are joined.
SENT = 500_000
#: A table cell or list term of fewer words is a value, not template by itself.
CELL_WORDS = 5
#: Template is on this share of a host's different pages at least.
SHARE = 0.25
#: Inside marked content (article, main), and for running text, on this share: a few pages may quote the same.
INNER = 0.6
TEXTUAL = set("p blockquote pre li q figure figcaption h2 h3 h4 h5 h6 td th dt dd".split())
# ---- fixed values: HTML element classes, names by which sites mark furniture
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
            "table tbody td tfoot th thead tr ul caption".split())
FURNITURE = set("nav aside footer form button select input textarea script style noscript template iframe object embed "
                "svg canvas math audio video head title dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
            "gdpr notice notices notification popup modal overlay sidebar sidebars rail menu menus nav navbar navigation "
            "breadcrumb breadcrumbs pagination footer header masthead topbar comment comments commentlist disqus replies "
            "reply related recommended share sharing social newsletter subscribe subscription signup login widget widgets "
            "skip toolbar tags".split())
#: Parts of hyphenated names that mark furniture, that deny it, and that go before "header".
PARTS = NAMES - set("header tags rail notice notices widget widgets reply masthead".split())
DENIED = set("no not non has with without hide open enabled".split())
SITE = set("site page main top global".split())
#: What is no text, whatever the lists of names say.
UNSEEN = set("script style noscript template iframe object embed svg canvas math audio video head title select input textarea button".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CELLS = set("td th dt dd".split())
CLOSES_P = BLOCK - set("body html caption legend optgroup option summary tbody td tfoot th thead tr".split())
# ----
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: One attribute; quotes in a name are part of it, a quote that never closes is part of the value.
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_REST = re.compile(r"[\s/]*")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    furniture: bool = False
    maybe: bool = False  # furniture by class, id or form tag
    kids: list = field(default_factory=list)  # Node or str


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of the tag whose name ends at ``at``, by lower-case name
    (the first of a name counts), and the place after its ``>``, or -1 if the
    page ends inside the tag."""
    found: dict[str, str] = {}
    while True:
        end = _REST.match(text, at).end()
        if end >= len(text):
            return found, -1
        if text[end] == ">":
            return found, end + 1
        m = _ATTR.match(text, end)
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id names furniture: by a whole name, or by the first
    or last part of a hyphenated one, unless that says what is not there."""
    for word in value.lower().split():
        if word in NAMES:
            if not (word == "header" and inside):
                return True
            continue
        parts = [x for x in re.split(r"[-_]+", word) if x]
        if len(parts) > 1 and not any(x in DENIED for x in parts):
            if parts[0] in PARTS or parts[-1] in PARTS or (parts[-1] == "header" and parts[0] in SITE):
                return True
    return False


def _furniture(tag: str, attrs: dict[str, str], inside: bool, lists: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it may be by its names."""
    if not lists:
        return tag in UNSEEN, False
    if tag != "form" and (tag in FURNITURE or (tag == "header" and not inside)):
        return True, False
    if tag == "main":
        return False, False
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or attrs.get("role", "").strip().lower() in ROLES:
        return True, False
    names = tag != "article" and any(_named(attrs[x], inside) for x in ("class", "id") if x in attrs)
    return False, tag == "form" or names


def _settle(root: Node) -> None:
    """Makes furniture of the elements that may be, but for those that hold
    the content."""
    order, todo, some, marked = [], [root], False, False
    while todo:
        node = todo.pop()
        if not node.furniture:
            order.append(node)
            some = some or node.maybe
            todo += [k for k in node.kids if isinstance(k, Node)]
    if not some:
        return
    info: dict[int, tuple[int, bool, bool]] = {}  # characters, holds an article, main or h1; holds an h1
    for node in reversed(order):
        size, holds, title = 0, node.tag in ("article", "main", "h1"), node.tag == "h1"
        for k in node.kids:
            if isinstance(k, str):
                size += len(k.strip())
            elif id(k) in info:
                n, has, h1 = info[id(k)]
                size, holds, title = size + n, holds or has, title or h1
        info[id(node)] = (size, holds, title)
        marked = marked or (size > 0 and (node.tag == "main" or (node.tag == "article" and title)))
    total = info[id(root)][0]
    for node in order:
        size, holds, _ = info[id(node)]
        node.furniture = node.maybe and not holds and (marked or 2 * size <= total)


class _Open:
    """The open elements. The places of each tag and of the blocks among them
    are kept, so that closing does not search the stack."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.inside = [root], {}, [], 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.inside += node.tag in ("article", "main")
        self.stack.append(node)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, 0 if none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.inside -= node.tag in ("article", "main")


#: An element that a new one ends, up to the innermost of the second.
_ENDS = {t: ((t,), ("ul", "ol", "dl", "table", "tbody", "menu", "select") + (() if t == "li" else ("tr",))) for t in ("li", "option", "tr")}
_ENDS["tr"] = (("tr",), ("ul", "ol", "dl", "table", "tbody", "menu", "select"))
_ENDS |= {t: (("dd", "dt"), _ENDS["option"][1]) for t in ("dd", "dt")} | {t: (("td", "th"), _ENDS["option"][1]) for t in ("td", "th")}


def parse(page: str | None, lists: bool = True) -> Node:
    """Element tree of a page, with the usual implied end tags. Without
    ``lists`` only what is no text at all is furniture."""
    text = page or ""
    root = Node("html")
    o, at = _Open(root), 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        kids = o.stack[-1].kids
        if not m:
            tail = text[at:]
            cut = tail.rfind("<")  # a tag that the end of the page cuts off
            kids.append(tail if cut < 0 or not re.match(r"</?[a-zA-Z!]?[^>]*\Z", tail[cut:]) or tail[cut + 1:cut + 2] in " \t\n" else tail[:cut])
            break
        if m.start() > at:
            kids.append(text[at:m.start()])
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                kids.append(m[0][9:].removesuffix("]]>"))
            continue
        attrs, at = _attributes(text, at)
        if at < 0:
            break  # cut off inside a tag
        if closing:
            place = o.last(tag)
            if tag == "p" and not place:
                kids.append(Node("p"))
            elif place and (tag in BLOCK or not o.blocks or o.blocks[-1] < place):
                o.close(place)  # an inline end tag does not close a block
            continue
        if tag in CLOSES_P and o.blocks and o.stack[o.blocks[-1]].tag == "p":
            o.close(o.blocks[-1])
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            place = o.last(*ended)
            if place and place > o.last(*(x for x in within if x not in ended)):
                o.close(place)
        if tag in ("html", "body"):
            continue
        node = Node(tag, *_furniture(tag, attrs, o.inside > 0, lists))
        o.stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
            if tag == "textarea" or tag == "title":
                node.kids.append(text[at:end.start() if end else len(text)])
            at = end.end() if end else len(text)
        elif tag not in VOID and not (text[at - 2] == "/" and tag not in BLOCK):
            o.push(node)
    _settle(root)
    return root


def _regions(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag outside furniture."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.furniture:
            continue
        if node.tag == tag:
            out.append(node)
        else:
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _size(regions: list[Node]) -> int:
    """Characters of text outside furniture."""
    size, todo = 0, list(regions)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            size += len(x.strip())
        elif not x.furniture:
            todo += x.kids
    return size


def main_regions(root: Node) -> list[Node]:
    whole, mains = [root], _regions(root, "main")
    articles = _regions(root, "article")
    if articles and 2 * _size(articles) > _size(whole):
        return articles
    if not mains or not (size := _size(mains)):
        return whole
    articles = [a for m in mains for a in _regions(m, "article")]
    return articles if 2 * _size(articles) > size else mains


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text))


def blocks(regions: list[Node], removed: dict[int, int] | None = None, title: str = "") -> list[str]:
    """The text blocks of the regions in page order, without furniture and
    without the template among the subtrees of ``removed``."""
    gone = _template(regions, removed, title) if removed else set()
    out, now = [], []

    def flush():
        line = _clean("".join(now)).strip()
        if line:
            out.append(line)
        now.clear()

    todo: list = list(reversed(regions))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.furniture and id(x) not in gone:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def _nodes(regions: list[Node]) -> list[Node]:
    """The elements outside furniture, each before its children."""
    order, todo = [], list(reversed(regions))
    while todo:
        node = todo.pop()
        if not node.furniture:
            order.append(node)
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return order


def title_of(root: Node) -> str:
    """The text of the page's ``title`` element."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _clean("".join(k for k in node.kids if isinstance(k, str))).strip()
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return ""


def _text(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.furniture:
            todo += reversed(x.kids)
    return _clean("".join(parts)).strip()


def subtree_hashes(regions: list[Node], title: str = "") -> dict[int, tuple[int, bool, bool, int]]:
    """By node: hash of its subtree, whether it is counted, whether it may be
    deleted, and its characters."""
    order = _nodes(regions)
    first = next((id(n) for n in order if n.tag == "h1"), None)
    info: dict[int, tuple[int, int, bool, bool]] = {}  # hash, characters, holds the title, holds a block
    beside: set[int] = {id(r) for r in regions}  # regions, inline elements beside text, values in cells
    for node in reversed(order):
        parts, size, block = [node.tag], 0, False
        own = id(node) == first or (node.tag in HEADINGS and title != "" and (t := _text(node)) != "" and t in title)
        running = False
        for k in node.kids:
            if isinstance(k, str):
                t = _clean(k).strip()
                size += len(t)
                running = running or t != ""
                parts.append(t)
            elif id(k) in info:
                h, n, has, blocks_in = info[id(k)]
                size, own, block = size + n, own or has, block or blocks_in or k.tag in BLOCK
                parts.append(f"\0{h}")
        if running:
            beside.update(id(k) for k in node.kids if isinstance(k, Node) and k.tag not in BLOCK)
        if node.tag in CELLS and not block and len(_text(node).split()) < CELL_WORDS:
            beside.update(id(n) for n in _nodes([node]))
        info[id(node)] = (xxhash.xxh64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63), size, own, block)
    total = sum(info[id(r)][1] for r in regions)
    counted = {n for n, (_, size, _, _) in info.items() if size and n not in beside}
    return {n: (h, n in counted, n in counted and not own and 2 * size <= total, size) for n, (h, size, own, _) in info.items()}


def candidates(page: str | None, lists: bool = True) -> tuple[int, list[int]]:
    """Hash of a page's main region, and the distinct hashes of its subtrees
    whose pages are counted."""
    root = parse(page, lists)
    regions = main_regions(root)
    info = subtree_hashes(regions, title_of(root))
    main = xxhash.xxh64_intdigest(",".join(str(info[id(r)][0]) for r in regions)) - (1 << 63)
    return main, sorted({h for h, counted, _, _ in info.values() if counted})


def _template(regions: list[Node], removed: dict[int, int], title: str) -> set[int]:
    """The nodes to delete: subtrees by their number of pages, as long as not
    more than half of the text is on so many pages. Near copies of a page
    share most of it; only what is on more pages than they are is template. A
    negative number of pages is a share below ``INNER``: enough outside marked
    content only, and not for running text."""
    info = subtree_hashes(regions, title)
    total = sum(info[id(r)][3] for r in regions)
    marked = {id(n) for r in regions if r.tag in ("article", "main") for n in _nodes([r])}
    tags = {id(n): n.tag for n in _nodes(regions)}
    pages = {n: abs(c) for n, (h, counted, _, _) in info.items() if counted and (c := removed.get(h, 0))
             and (c > 0 or (n not in marked and tags[n] not in TEXTUAL))}
    gone: set[int] = set()
    for level in sorted(set(pages.values()), reverse=True):
        more, size, todo = set(), 0, list(regions)
        while todo:  # the outermost of those on so many pages
            node = todo.pop()
            if pages.get(id(node), 0) >= level:
                size += info[id(node)][3]
                more.add(id(node))
            else:
                todo += [k for k in node.kids if isinstance(k, Node) and not k.furniture]
        if 2 * size > total:
            break
        gone = {n for n, c in pages.items() if c >= level and info[n][2]}
    return gone


def extract(page: str | None, removed: dict[int, int] | None = None, lists: bool = True) -> str:
    """Text of a page without the subtrees of ``removed`` (hash -> pages)."""
    root = parse(page, lists)
    return "\n".join(blocks(main_regions(root), removed, title_of(root) if removed else ""))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row. Without ``lists``
    recurrence alone tells furniture from content."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    src = src.withColumn("host", F.xxhash64(host))

    def hashed(batches):
        for b in batches:
            found = [candidates(t, lists) for part in text_slices(b.column(1)) for t in part]
            yield pa.record_batch([b.column(0), pa.array([m for m, _ in found], pa.int64()),
                                   pa.array([h for _, h in found], pa.list_(pa.int64()))], names=["host", "main", "hashes"])
    # every main text of a host once, so that copies of a page do not make its parts template
    seen = src.select("host", "html").mapInArrow(hashed, "host long, main long, hashes array<long>")
    distinct = durable(seen.groupBy("host", "main").agg(F.first("hashes").alias("hashes")))
    # a subtree h of a host is the key h ^ host
    key = F.col("host").bitwiseXOR(F.col("h")).alias("g")
    held = distinct.select("host", F.explode("hashes").alias("h")).groupBy("host", key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = F.when(F.col("n") >= INNER * F.col("pages"), F.col("n")).otherwise(-F.col("n")).alias("n")
    common = durable(held.join(sizes, "host").where(F.col("n") >= share * F.col("pages")).select("g", often))
    kind = dict(src.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def out(b, texts):
        return pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                               names=["page_id", "url", "text", "n_chars"])
    few = common.limit(SENT + 1).count() <= SENT
    if few:
        rows = common.orderBy("g").toArrow()
        sent = src.sparkSession.sparkContext.broadcast((rows["g"].to_numpy(), rows["n"].to_numpy()))

        def texts(batches):
            keys, counts = sent.value
            for b in batches:
                found = []
                hosts = b.column("host").to_pylist()
                for i, page in enumerate(t for part in text_slices(b.column("html")) for t in part):
                    found.append(extract(page, _Removed(hosts[i], keys, counts) if len(keys) else None, lists))
                yield out(b, found)
        return src.select("page_id", "url", "html", "host").mapInArrow(texts, schema)

    # rows are told apart by what they hold; equal ones get equal lists
    row = F.xxhash64("host", "html").alias("k")
    hashes = src.select(row, "host", "html").dropDuplicates(["k"])

    def each(batches):
        for b in batches:
            found = [candidates(t, lists)[1] for part in text_slices(b.column(2)) for t in part]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["k", "host", "hashes"])
    listed = hashes.mapInArrow(each, "k long, host long, hashes array<long>").select("k", F.explode("hashes").alias("h"), "host")
    gone = durable(listed.select("k", "h", key).join(common, "g").groupBy("k").agg(F.collect_set(F.struct("n", "h")).alias("gone")))

    def joined(batches):
        for b in batches:
            found, gone = [], b.column("gone").to_pylist()
            for i, page in enumerate(t for part in text_slices(b.column("html")) for t in part):
                found.append(extract(page, {x["h"]: x["n"] for x in gone[i] or ()}, lists))
            yield out(b, found)
    return (src.select("page_id", "url", "html", row).join(gone, "k", "left").select("page_id", "url", "html", "gone").mapInArrow(joined, schema))


class _Removed:
    """The removal table of a host: ``get`` by subtree hash."""

    def __init__(self, host: int, keys: np.ndarray, counts: np.ndarray):
        self.host, self.keys, self.counts = host, keys, counts

    def get(self, h: int, default: int = 0) -> int:
        g = h ^ self.host
        i = int(self.keys.searchsorted(g))
        return int(self.counts[i]) if i < len(self.keys) and self.keys[i] == g else default
