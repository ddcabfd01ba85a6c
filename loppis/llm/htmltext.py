"""Main text of web pages: site templates are found by counting element subtrees for each host.

A page is read once, with the end tags that HTML lets authors leave out. Elements that by name or role are menus,
headers, footers, sidebars, notices, forms, scripts or styles are left out. By class and id, adverts and reader
comments are left out wherever an attribute names exactly that; other marks count only outside an article or main
element, and only as the last part of a hyphenated name, so that "share-price" is no share button. Every other block
element's subtree gets a hash; Spark counts in how many different main parts of its host each occurs, and subtrees
found in a large share of them are deleted as its template. Pages with the same main part count once whatever their
heads, comments, menus and footers are, and so does an article beside different other ones; so copies of an article
do not turn its paragraphs into a template. An outermost article or main element itself always stays. Articles that
differ in a few paragraphs do count apart.

Reading takes time and memory in proportion to the page, however deep its elements nest and whatever is left open.
Blocks are joined in page order by a line feed, white space inside a block is one space, character references are
decoded. Nulls and empty pages give an empty text, a null url is a host of its own. Repeated rows each get a result.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>=]")
SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$)")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that never belong to the main text.
NEVER = frozenset("head script style textarea title noscript iframe template svg math canvas object audio video nav aside form footer button select dialog menu".split())
#: A start tag of the key closes an open element of the values, up to the nearest element in SCOPES.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select article section main div body html aside nav header footer form td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MAINS = frozenset(("article", "main"))
#: Whole class and id names of adverts and reader comments.
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsored comment comments comment-list comments-area replies disqus disqus_thread respond".split()
)
#: Further names outside an article or main element, whole or as the last part of a hyphenated name.
MARKS = ADVERTS | frozenset(
    "promo promos promotion promotions banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar cookie cookies consent gdpr "
    "notice notices alert alerts popup popups modal modals overlay overlays newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "widgets pagination pager toolbar skip-link skiplink copyright disclaimer logo branding".split()
)
LAST_PART = re.compile(r"[^-_]*$")


class Page(NamedTuple):
    """Lines of the main part; of its block subtrees the hash, the lines (from, to) and the hash of the outermost
    element they are in; the hash of the whole main part."""

    lines: list[str]
    trees: list[int]
    starts: list[int]
    ends: list[int]
    roots: list[int]
    key: int


class _Open:
    """An element that is still open."""

    __slots__ = ("tag", "out", "block", "hash", "start")

    def __init__(self, tag: str, out: bool, block: bool, start: int):
        self.tag, self.out, self.block, self.start = tag, out, block, start
        self.hash = xxhash.xxh64(tag.encode("utf-8", "surrogatepass"))


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is not main text; inside: within an article or main element."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id"):
            names = value.split()
            if not ADVERTS.isdisjoint(names):
                return True
            if not inside and tag not in MAINS and any(n in MARKS or LAST_PART.search(n).group() in MARKS for n in names):
                return True
        elif tag in MAINS:
            continue
        elif name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return tag not in MAINS and HIDDEN.search(ATTRIBUTE.sub(" ", attributes)) is not None


def _tag_end(page: str, at: int) -> int:
    """Where the tag's closing bracket stands, outside quoted values; -1 if a value is never closed."""
    while True:
        m = STOP.search(page, at)
        if m is None:
            return -1
        if m.group() == ">":
            return m.start()
        at = SPACE.match(page, m.end()).end()
        if page[at : at + 1] in ('"', "'"):
            at = page.find(page[at], at + 1) + 1
            if not at:
                return -1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text with its content as rest; start and end tags with their attributes as rest.

    A bracket that opens no tag is text. Once a quoted value turns out to be left open, the tags from there on end at
    their first closing bracket, so that no part of a page is looked through more than twice.
    """
    at = text = 0
    last, strict = page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            break
        m = NAME.match(page, start + 1)
        if m is None and not page.startswith(("<!", "<?"), start):
            at = start + 1
            continue
        if text < start:
            yield "text", "", page[text:start]
        if m is None:
            end = page.find("-->", start + 4) + 2 if page.startswith("<!--", start) else page.find(">", start)
            at = text = end + 1 if end > 1 else len(page)
            continue
        end = _tag_end(page, m.end()) if strict else page.find(">", m.end())
        if end < 0:
            strict = False
            end = page.find(">", m.end())
            if end < 0:
                text = start
                break
        name = m.group(1).lower()
        at = text = end + 1
        yield ("end" if page[start + 1] == "/" else "start"), name, page[m.end() : end]
        if name in RAW and page[start + 1] != "/":  # its content goes up to the end tag
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", stop.start()) if stop else -1
            at = text = close + 1 if close >= 0 else len(page)
    if text < len(page):
        yield "text", "", page[text:]


def read(page: str) -> Page:
    """Lines and block subtrees of a page's main part: its outermost article or main elements with text, or else all."""
    lines: list[str] = []
    line: list[str] = []
    stack = [_Open("", False, True, 0)]
    places: dict[str, list[int]] = {}  # of each tag, where on the stack it is open
    scopes: list[int] = [0]
    trees: list[tuple[int, int, int, bool]] = []  # in the order of their ends; whether in an article or main element
    mains: list[tuple[int, int, int]] = []
    inside = dropped = 0

    def flush() -> None:
        if line:
            words = " ".join("".join(line).split())
            line.clear()
            if words:
                lines.append(words)

    def close(to: int) -> None:
        nonlocal inside, dropped
        while len(stack) > to:
            n = stack.pop()
            if n.tag:
                places[n.tag].pop()
                if n.tag in SCOPES:
                    scopes.pop()
            inside -= n.tag in MAINS
            dropped -= n.out
            if n.out or dropped:
                continue
            value = n.hash.intdigest()
            if n.block:
                flush()
                if len(lines) > n.start:
                    if n.tag in MAINS and not inside:
                        mains.append((_signed(value), n.start, len(lines)))
                    else:
                        trees.append((_signed(value), n.start, len(lines), inside > 0))
            if stack:
                stack[-1].hash.update(value.to_bytes(8, "little"))

    for kind, tag, rest in _tokens(page):
        if kind == "text":
            if not dropped:
                text = html.unescape(rest) if "&" in rest else rest
                if words := text.split():
                    stack[-1].hash.update(" ".join(words).encode("utf-8", "surrogatepass"))
                line.append(text)
            continue
        if kind == "end":
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in VOID:
            if not dropped and tag == "br":
                line.append(" ")
            elif not dropped and tag == "hr":
                flush()
                stack[-1].hash.update(b"<hr>")
            continue
        if tag in RAW:
            continue
        block = tag in BLOCKS
        if block and (p := places.get("p")) and p[-1] > scopes[-1]:  # an open paragraph ends here
            close(p[-1])
        while tag in CLOSES:
            open_ = max((places[t][-1] for t in CLOSES[tag] if places.get(t)), default=-1)
            if open_ < max(1, scopes[-1]):
                break
            close(open_)
            if tag != "tr":
                break
        if rest.endswith("/") and not block:
            continue
        if block and not dropped:
            flush()
        out = _left_out(tag, rest, inside > 0)
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(_Open(tag, out, block, len(lines)))
        inside += tag in MAINS
        dropped += out
    whole = stack[0].hash
    close(1)
    flush()
    if not mains:
        key = _signed(whole.intdigest())
        return Page(lines, [t[0] for t in trees], [t[1] for t in trees], [t[2] for t in trees], [key] * len(trees), key)
    key = mains[0][0] if len(mains) == 1 else _signed(xxhash.xxh64_intdigest(b"".join(k.to_bytes(8, "little", signed=True) for k, _, _ in mains)))
    made = Page([], [], [], [], [], key)
    within = [t for t in trees if t[3]]
    at = 0
    for root, a, b in mains:  # both in page order
        moved = len(made.lines) - a
        while at < len(within) and within[at][2] <= b:
            tree, start, end, _ = within[at]
            for into, x in zip(made[1:5], (tree, start + moved, end + moved, root), strict=True):
                into.append(x)
            at += 1
        made.lines.extend(lines[a:b])
    return made


def main_text(page: str) -> str:
    """The main part's lines, without any host's template taken away."""
    return "\n".join(read(page).lines)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def without(lines: list[str], trees: np.ndarray, starts: np.ndarray, ends: np.ndarray, template: np.ndarray) -> str:
    """The lines outside the template's subtrees."""
    gone = np.isin(trees, template)
    if gone.any():
        edge = np.zeros(len(lines) + 1, np.int64)
        np.add.at(edge, starts[gone], 1)
        np.subtract.at(edge, ends[gone], 1)
        lines = [x for x, g in zip(lines, np.cumsum(edge[:-1]).tolist(), strict=True) if not g]
    return "\n".join(lines)


def host(url_col: str):
    """Lower-cased host of a url, empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch_rows: int = 200) -> DataFrame:
    """page_id, url, host and what read() gives of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(url_col).alias("host"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    names = ("lines", "trees", "starts", "ends", "roots", "key")
    kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), batch_rows):
                b = whole.slice(at, batch_rows)
                each = [read(x or "") for x in b.column("html").to_pylist()]
                cols = list(zip(*each, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("page_id", "url", "host")), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                    names=["page_id", "url", "host", *names],
                )

    return rows.mapInArrow(
        run, f"page_id {kind}, url string, host string, lines array<string>, trees array<bigint>, starts array<int>, ends array<int>, roots array<bigint>, key bigint"
    )


def templates(pages: DataFrame, least_pages: int = 5, share: float = 0.5) -> DataFrame:
    """(host, template) of parsed pages: hashes of the subtrees in at least `share` of a host's different main parts,
    and least_pages.

    A subtree's count is that of the pages with different main parts or of the different outermost elements that hold
    it, whichever is less. A host's list is bounded by the subtrees of a page divided by the share.
    """
    # kind 1: a page's main part holds the tree, 2: an outermost element does, 3: where that is all of the main part
    def kinds(tree, root):
        as_row = lambda key, k: F.struct(tree.alias("tree"), key.alias("key"), F.lit(k).cast("byte").alias("kind"))
        return F.when(root == F.col("key"), F.array(as_row(root, 3))).otherwise(F.array(as_row(F.col("key"), 1), as_row(root, 2)))

    held = F.array_distinct(F.flatten(F.zip_with("trees", "roots", kinds)))
    # the same main parts meet before they are counted
    once = pages.select("host", F.explode(held).alias("h")).groupBy("host", "h.tree", "h.key").agg(F.bit_or("h.kind").alias("kind"))
    of_pages, of_roots = (F.count_if(F.col("kind").bitwiseAND(F.lit(k).cast("byte")) > 0) for k in (1, 2))
    counted = once.groupBy("host", "tree").agg(F.least(of_pages, of_roots).alias("n")).filter(F.col("n") >= least_pages)
    total = pages.select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = counted.join(total, "host").filter(F.col("n") >= F.col("pages") * share)
    return often.groupBy("host").agg(F.collect_set("tree").alias("template"))


def _beside(pages: DataFrame, lists: DataFrame, salts: int = 64) -> DataFrame:
    """Pages with their host's template, dealt over salts where a host has a hundredth of the pages or more."""
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    # at most 100 hosts by their definition
    hot = F.broadcast(sizes.filter(F.col("n") * 100 >= sizes.agg(F.sum("n")).scalar()).select("host", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "lines"), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = pages.join(hot, "host", "left").withColumn("salt", salt).drop("hot")
    return dealt.join(lists.join(hot, "host", "left").select("host", F.explode(copies).alias("salt"), "template"), ["host", "salt"], "left")


def extract(
    pages: DataFrame, least_pages: int = 5, share: float = 0.5, broadcast_trees: int = 200_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every page. Every page is read once, into a table in the shared folder."""
    rows = stored(parsed(pages, id_col, url_col, html_col))
    lists = cut(templates(rows, least_pages, share))
    # templates are broadcast after a count of their hosts and subtrees, else joined
    size = lists.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(lists), "host", "left") if size <= broadcast_trees else _beside(rows, lists)

    def clean(lines: pa.Array, trees: pa.Array, starts: pa.Array, ends: pa.Array, template: pa.Array) -> pa.Array:
        none = np.empty(0, np.int64)
        arrays = ([none if not v.is_valid else v.values.to_numpy() for v in c] for c in (trees, starts, ends, template))
        return pa.array([without(x, *more) for x, *more in zip(lines.to_pylist(), *arrays, strict=True)], pa.string())

    text = F.arrow_udf(clean, "string").asNondeterministic()("lines", "trees", "starts", "ends", "template")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
