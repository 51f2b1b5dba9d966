"""Main text of pages: hand-made pages of many layouts, the tables' pages against
a plain reading, densities against their recursive definition."""

from __future__ import annotations

import glob
import html
import math
import os
import re

import pytest

from ledgerline.llm.html_text import PageReader, _measure, composite_density, extract_main_text, main_blocks

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "This paragraph has a good many words, so that its density is that of an article. "
NAV = "<nav><ul><li><a href='/'>Home</a><li><a href='/a'>About</a></ul></nav>"

PAGES = [
    ("empty", "", []),
    ("no markup", "just  words &amp; more", ["just words & more"]),
    ("only menus", NAV, []),
    ("article", f"<body>{NAV}<div class=ad>Buy this now.</div><article><h1>Title</h1><p>{LONG}</p><p>Be.</p></article><footer>&copy; us</footer>", ["Title", LONG.strip(), "Be."]),
    ("short article", f"<body>{NAV}<div class='ad'>Buy this product right now, it is so good that nobody can resist.</div><article><h1>T</h1><p><b>T<br><p>X</article><footer>All rights reserved by us and everyone</footer>", ["T", "T", "X"]),
    ("no article element", f"<body><div id=page>{NAV}<div class='header'>My site</div><div class='post'><h2>Head</h2><p>{LONG}</p><p>{LONG * 2}</p><p>Fin.</p></div><div id='sidebar'><p>{LONG}</p></div><div class='comments'><p>{LONG * 3}</p></div></div>", ["Head", LONG.strip(), (LONG * 2).strip(), "Fin."]),
    ("unnamed menu", f"<body><div><a href=1>One page</a> <a href=2>Two page</a> <a href=3>Three page</a></div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>", ["Head", LONG.strip(), LONG.strip()]),
    ("inline markup", f"<body><main><p>{LONG}<b>bold</b> <i>and</i> <a href=x>a link</a>, <code>c</code> {LONG}</p><p>No</p></main>", [f"{LONG}bold and a link, c {LONG}".strip(), "No"]),
    ("broken", "<body><article><p>one <b>two<p>three</i></b> four<div>five<p>six</div>seven<li>eight<li>nine", ["one two", "three four", "five", "six", "seven", "eight", "nine"]),
    ("references", "<article><p>a&nbsp;b &lt;p&gt; &#233;&#x1F600; &euro;5 &unknown; AT&T</p></article>", ["a b <p> é😀 €5 &unknown; AT&T"]),
    ("scripts", "<article><p>in</p><script>var a='<p>no</p>';</script><style>p{}</style><template><p>no</p></template><!-- <p>no</p> --><p>out</p><noscript>no</noscript></article>", ["in", "out"]),
    ("forms and notices", f"<body class='has-sidebar'><div role=dialog>We use cookies</div><div id='cookieConsent'><p>{LONG}</p></div><article><header><h1>Own head</h1></header><p>{LONG}</p><form><label>Mail</label><input name=m><button>Go</button></form><div class='share-buttons'>Share it</div><aside>See also</aside><section class=comments><p>{LONG}</p></section><p hidden>gone</p><p style='display: none'>gone</p></article>", ["Own head", LONG.strip()]),
    ("lists and tables", f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><th>a<th>b<tr><td>1<td>2</table><pre> x\n   y </pre><blockquote>q</blockquote></article>", [LONG.strip(), "one", "two", "a b", "1 2", "x y", "q"]),
    ("cards", f"<body><article><h1>H</h1><p>{LONG}</p><p>{LONG}</p><div class=related><article><p>{LONG}</p></article></div></article>", ["H", LONG.strip(), LONG.strip()]),
    ("page in a form", f"<body><form id=aspnetForm><div><p>{LONG}</p><p>{LONG}</p></div></form>", [LONG.strip(), LONG.strip()]),
    ("sections", "<body><article>" + "".join(f"<section><h2>S{i}</h2><p>{LONG * i}</p><p>Be.</p></section>" for i in (1, 5, 2)) + "</article>", [x for i in (1, 5, 2) for x in (f"S{i}", (LONG * i).strip(), "Be.")]),
    ("head left open", f"<html><head><title>no</title><body><p>{LONG}</p>", [LONG.strip()]),
    ("upper case", f"<BODY><NAV>menu</NAV><ARTICLE><P CLASS=x>{LONG}</P></ARTICLE></BODY>", [LONG.strip()]),
    ("deep", "<div>" * 100_000 + "</p></b>" * 100_000 + LONG, [LONG.strip()]),
    ("cut off", f"<article><p>{LONG}</p><p>end <a href='", [LONG.strip(), "end"]),
]


@pytest.mark.parametrize("name,page,want", PAGES, ids=[p[0] for p in PAGES])
def test_layouts(name, page, want):
    assert main_blocks(page) == want


def plain_reading(page):
    """Blocks of the tables' pages: p and h1 of the article."""
    out = []
    for block in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S).group(1)):
        text = " ".join(html.unescape(re.sub(r"</?b>", "", block.replace("<br>", " "))).split())
        out += [text] if text else []
    return "\n\n".join(out)


@pytest.mark.skipif(not glob.glob(f"{FOLDER}/pages.parquet"), reason="no tables here")
def test_whole_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = plain_reading(r["html"])
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def test_densities_by_definition():
    reader = PageReader()
    reader.feed(PAGES[5][1] + PAGES[7][1])
    reader.close()
    reader._pop_to(0)
    nodes, runs, share = reader.nodes, reader.runs, reader.page_link_chars / reader.page_chars
    for n in nodes:
        n.out = False
    _measure(nodes, runs, share)

    def sums(i):
        own = [(len(r.text), r.tags, r.link_chars, r.link_tags) for r in runs if r.node == i]
        below = [(*sums(k)[:1], sums(k)[1] + 1, *sums(k)[2:]) for k, n in enumerate(nodes) if n.parent == i]
        return tuple(map(sum, zip(*(own + below), strict=True))) if own + below else (0, 0, 0, 0)

    def density(c, t, lc, lt):
        if c == 0:
            return 0.0
        base = math.log(c / (c - lc or 1) * lc + share * c + math.e)
        return c / (t or 1) * max(0.0, math.log(c / (lc or 1) * (t or 1) / (lt or 1), base))

    for i, n in enumerate(nodes):
        assert math.isclose(n.density, density(*sums(i)), rel_tol=1e-9)
        children = [density(*sums(k)) for k, m in enumerate(nodes) if m.parent == i] + [density(len(r.text), r.tags, r.link_chars, r.link_tags) for r in runs if r.node == i]
        assert math.isclose(n.total, sum(children), rel_tol=1e-9, abs_tol=1e-12)
    assert composite_density(100, 2, 0, 0, 0.1) > composite_density(100, 2, 90, 2, 0.1) and composite_density(0, 1, 0, 0, 0.1) == 0


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, id string"
    long = "<article>" + f"<p>{LONG}</p>" * 30_000 + "</article>"
    rows = [(1, None, None, "x", 1, "y"), (None, "u", "", "x", 1, "y"), (2, "u", long, None, None, None), (3, "u", "<p>same", "x", 1, "y"), (3, "u", "<p>same", "x", 1, "y")]
    got = extract_main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"] or 0), r["text"][:4], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "", 0), (2, "This", 30_000 * (len(LONG.strip()) + 2) - 2), (3, "same", 4), (3, "same", 4)]
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0
