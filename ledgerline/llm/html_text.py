"""Main text of web pages by composite text density.

Each page is read on its own, so pages need no shuffle. Elements that say of
themselves what they are (menus, footers, adverts, forms, comments and the like,
by tag, role or class) hold no article text. Of what is left every block element
gets its link-adjusted characters per tag and the sum of its children's; the
block of the largest sum and the least density on its path to the body tell what
belongs to the article."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_arrow, text_slices, trimmed

_VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose start and end separate blocks.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Cells stay in the block of their row.
_BLOCK = _BLOCK - {"td", "th"}
_ENDS_P = _BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "tbody", "tfoot", "thead", "tr"}
#: What the start of an element ends, up to which ancestor.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Not text at all.
_UNSEEN = frozenset("applet audio canvas datalist embed head iframe math noembed noframes noscript object script style svg template title video".split())
#: Never the article: menus, footers, sidebars, controls.
_NEVER = frozenset("aside button dialog footer menu nav search select textarea".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of classes and ids that name what is not the article (fixed values).
_NAMES = frozenset(
    "ad ads adsbox adsense advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dfp discussion disqus donate footer footers gdpr header hidden leaderboard login masthead menu menus modal nav navbar navigation navlinks newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promoted promotion reactions recommendation recommendations recommended related replies reply respond rightrail search share sharebar sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola toc toolbar topbar trending widget widgets".split()
)
#: A header of these is the article's own.
_OWN = frozenset("article content entry post story".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")
_CUT_TAG = re.compile(r"<[A-Za-z/!?]")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def names_noise(names: str) -> bool:
    """Whether classes or an id name something else than the article; has-x,
    with-x and no-x name it only for what is inside."""
    for name in names.split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if words and words[0] in ("has", "with", "no", "without"):
            continue
        found = _NAMES.intersection(words)
        if found and not (found == {"header"} and _OWN.intersection(words)):
            return True
    return False


@dataclass
class Node:
    """A block element: its place in the tree, whether it is in an article, is named
    like noise, is left out, and sums over its subtree."""

    tag: str
    parent: int
    nested: bool = False
    named: bool = False
    out: bool = False
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


@dataclass
class Run:
    """Text of a block between two block boundaries; inline elements count as tags."""

    node: int
    text: str
    tags: int
    link_chars: int
    link_tags: int


class PageReader(HTMLParser):
    """Block tree and text runs of a page of any, also broken, markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1)]
        self.runs: list[Run] = []
        #: Open elements: (tag, node of the block or None for inline ones).
        self.open: list[tuple[str, int | None]] = []
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.block = [0]
        self.unseen = 0
        self.links = 0
        self.page_chars = self.page_link_chars = 0
        self._new()

    def _new(self) -> None:
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.tags = self.link_tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            linked = min(len(" ".join("".join(self.linked).split())), len(text))
            self.runs.append(Run(self.block[-1], text, self.tags, linked, self.link_tags))
            self.page_chars += len(text)
            self.page_link_chars += linked
        self._new()

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, node = self.open.pop()
            self.count[tag] -= 1
            if tag in _UNSEEN:
                self.unseen -= 1
            if tag == "a":
                self.links -= 1
            if node is not None:
                self.flush()
                self.block.pop()

    def _open(self, tag: str, node: int | None) -> None:
        self.open.append((tag, node))
        self.count[tag] += 1

    def _end_implied(self, tags: Iterable[str], up_to: Iterable[str]) -> None:
        if not any(self.count[t] for t in tags):
            return None
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in tags:
                return self._pop_to(depth)
            if self.open[depth][0] in up_to:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            if tag not in _VOID and tag in _UNSEEN:
                self._open(tag, None)
                self.unseen += 1
            if tag != "body":  # a body ends a head that was left open
                return
            self._pop_to(0)
        if tag in _ENDS_P:
            self._end_implied({"p"}, {"td", "th", "table", "button", "caption", "object"})
        if tag in _ENDS:
            self._end_implied(*_ENDS[tag])
        if tag == "a":
            self._end_implied({"a"}, {"td", "th", "table", "caption"})
        if tag in _VOID:
            self.tags += tag not in ("meta", "link", "base", "hr")
            if tag in ("br", "hr", "img", "input", "embed"):
                self.pieces.append(" ")
            if tag == "hr":
                self.flush()
            return
        if tag in ("td", "th"):
            self.pieces.append(" ")
        if tag in _UNSEEN:
            self._open(tag, None)
            self.unseen += 1
            return
        values = {k: v or "" for k, v in attrs}
        noise = tag in _NEVER or values.get("role", "").strip().lower() in _ROLES or "hidden" in values or bool(_HIDING.search(values.get("style", "")))
        named = tag in ("form", "header") or names_noise(f"{values.get('class', '')} {values.get('id', '')}")
        if tag in _BLOCK or noise or named:
            self.flush()
            inside = self.count["article"] + self.count["main"] > 0
            named = named and tag not in ("html", "body", "article", "main") and not (tag == "header" and inside and not names_noise(values.get("class", "")))
            self.nodes.append(Node(tag, self.block[-1], inside, named, noise and tag not in ("html", "body", "article", "main")))
            self._open(tag, len(self.nodes) - 1)
            self.block.append(len(self.nodes) - 1)
            return
        self._open(tag, None)
        self.tags += 1
        if tag == "a":
            self.links += 1
            self.link_tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1) if self.count[tag] else ():
            open_tag, node = self.open[depth]
            if open_tag == tag:
                return self._pop_to(depth)
            if node is not None and tag not in _BLOCK and tag not in _UNSEEN and tag not in _NEVER and tag not in ("td", "th"):
                return None  # an inline end does not reach over a block
        if tag == "p":
            self.flush()
        return None

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.pieces.append(data)
            if self.links:
                self.linked.append(data)


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Characters per tag times log(chars / link chars * tags / link tags) to a
    base that grows with the share of link text of the block and the page; counts
    of 0 that divide are 1. On a page without links every base is the same."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(math.log(chars / max(chars - link_chars, 1) * link_chars + page_share * chars + math.e))
    return chars / tags * max(math.log(chars / links * tags / link_tags), 0.0) / (base if page_share else 1.0)


def _measure(nodes: list[Node], runs: list[Run], page_share: float) -> None:
    """Sums, densities and density sums of the blocks that are not out."""
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.total = 0.0
    for r in runs:
        n = nodes[r.node]
        if not n.out:
            n.chars, n.tags = n.chars + len(r.text), n.tags + r.tags
            n.link_chars, n.link_tags = n.link_chars + r.link_chars, n.link_tags + r.link_tags
            n.total += composite_density(len(r.text), r.tags, r.link_chars, r.link_tags, page_share)
    for n in reversed(nodes):  # children come after their parents
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, page_share)
        if n.parent >= 0 and not n.out:
            up = nodes[n.parent]
            up.chars, up.tags = up.chars + n.chars, up.tags + n.tags + 1
            up.link_chars, up.link_tags = up.link_chars + n.link_chars, up.link_tags + n.link_tags
            up.total += n.density


def _path(nodes: list[Node], i: int) -> list[int]:
    out = []
    while i >= 0:
        out.append(i)
        i = nodes[i].parent
    return out


def content_root(nodes: list[Node], body: int) -> tuple[int, float]:
    """(block that holds the article, threshold of density).

    The densest sum and the least density on its path to the body are taken; in
    every block of at least that density the densest sum below it counts too, and
    the root is the last common ancestor of all these. An article or main element
    around it, or one that holds most of its text, is taken instead."""
    best = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        if not nodes[i].out and nodes[best[i]].total >= nodes[best[up]].total:
            best[up] = best[i]
    top = best[body]
    path = _path(nodes, top)
    path = path[: path.index(body) + 1]
    least = min(nodes[i].density for i in path)
    for i in path:
        if nodes[i].tag in ("article", "main"):
            return i, least
    marks = {best[i] for i, n in enumerate(nodes) if not n.out and n.chars and n.density >= least and i >= body} | {top}
    below = [int(i in marks) for i in range(len(nodes))]
    for i in range(len(nodes) - 1, 0, -1):
        below[nodes[i].parent] += below[i]
    root = next((i for i in path if below[i] == len(marks)), body)
    for i, n in enumerate(nodes):
        if n.tag in ("article", "main") and not n.out and not n.nested and 2 * n.chars > nodes[root].chars and root in _path(nodes, i):
            return i, least
    return root, least


def main_blocks(html: str) -> list[str]:
    """Blocks of the article of a page, in page order."""
    reader = PageReader()
    reader.feed(html)
    if _CUT_TAG.match(reader.rawdata):  # a tag or comment that the page's end cuts off
        reader.rawdata = ""
    reader.close()
    reader._pop_to(0)
    reader.flush()
    nodes, runs = reader.nodes, reader.runs
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    share = reader.page_link_chars / reader.page_chars if reader.page_chars else 0.0
    # A name does not make a block noise that the page's article is in.
    holds = set()
    for i, n in enumerate(nodes):
        if n.tag in ("article", "main"):
            k = n.parent
            while k >= 0 and k not in holds and not n.nested:
                holds.add(k)
                k = nodes[k].parent
    never = [n.out for n in nodes]
    for by_name in (True, False):
        for i, n in enumerate(nodes):
            up = n.parent >= 0 and nodes[n.parent].out
            n.out = up or never[i] or (by_name and n.named and i not in holds)
        _measure(nodes, runs, share)
        if nodes[0].chars:
            break
    else:
        return []
    if not nodes[body].chars:
        body = 0
    root, least = content_root(nodes, body)
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = not n.out and (i == root or (n.parent >= 0 and inside[n.parent] and not (n.density < least and 2 * n.link_chars > n.chars and n.tag in ("div", "ul", "ol", "section", "table", "dl") and n.link_tags > 1)))
    return [r.text for r in runs if inside[r.node]]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row: the blocks of the article,
    each with its white space (of any kind, also no-break) as single spaces, with
    an empty line between them; br is white space, cells of a row are one block.

    A null or empty page, or one without text outside menus and the like, has an
    empty text. Pages of any length are read whole, broken markup as far as it
    goes; repeated rows and null ids or urls are treated like any others; extra
    columns are ignored; no pages give no rows."""
    bound_arrow(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pieces in text_slices(batches, "html"):
            texts = ["\n\n".join(main_blocks(h)) if h else "" for h in pieces]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    asked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    found = asked.mapInArrow(trimmed(run), f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
