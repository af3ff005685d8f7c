"""Main text: templates inside articles, copies, hosts of any size, names that don't name the part, hostile pages."""

import random
import time
from xml.etree import ElementTree

import pytest

from strandlake.llm import htmltext

LONG = "some words of the text " * 40


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["row"].page_id: r.text for r in htmltext.extract(pages).collect()}


def test_templates_inside_articles_go(spark):
    page = "<html><body><main><article><h1>Title {0}</h1><p>own {0}</p><div class='box'><p>About us</p>Legal</div></article><section>All rights</section></main></body></html>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(8)] + [(100, "http://b.example/", page.format(100))]
    assert texts(spark, rows) == {k: f"Title {k} own {k}" for k in range(8)} | {100: "Title 100 own 100 About us Legal All rights"}


def test_copies_count_once(spark):
    page = "<body><div><p>A full article.</p><p>Its second part.</p></div>{0}</body>"
    rows = [(k, f"http://a.example/{k}", page.format("")) for k in range(6)] + [(10 + k, None, page.format("")) for k in range(6)]
    rows += [(20 + k, f"http://c.example/{k}", page.format(f"<aside>advert {k}</aside>").replace("<div>", "<main>").replace("</div>", "</main>")) for k in range(6)]
    rows += [(30 + k, f"http://c.example/n{k}", f"<main>own {k}</main>") for k in range(3)]
    whole = "A full article. Its second part."
    assert texts(spark, rows) == {k: f"own {k - 30}" if k >= 30 else whole for k, _, _ in rows}


def test_templates_of_copied_pages_go(spark):
    rows = [(k, "http://a.example/", f"<main><p>own {k // 2}</p><p>box</p></main>") for k in range(12)]
    assert texts(spark, rows) == {k: f"own {k // 2}" for k, _, _ in rows}


def test_templates_of_a_section_go_on_a_large_host(spark):
    rows = [(k, "http://big.example/", f"<p>own {k}</p>" + "<div>section</div>" * (k < 120) + "<div>few</div>" * (k % 100 == 0)) for k in range(900)]
    assert texts(spark, rows) == {k: f"own {k}" + " few" * (k % 100 == 0) for k in range(900)}


def tree_pages(rng):
    """Well-formed pages of three hosts: boxes shared by a host or a section, sentences that some articles share, copies, nested parts."""
    boxes = [f"<div class='k{k}'><p>box {k}</p><div>more of {k}</div></div>" for k in range(6)]
    rows = []
    for n in range(90):
        host, own = n % 3, f"page {n if n % 9 else 0}"
        parts = [f"<p>{own} first</p>", f"<section class='s'><p>{own} second</p>{rng.choice(['', '<p>A common line.</p>'])}</section>"]
        parts += [b for k, b in enumerate(boxes) if (k < 3 and host == k) or (k >= 3 and n % 7 < k - 2)]
        rng.shuffle(parts)
        body = "".join(parts)
        body = f"<div id='m'>{body}</div>" if n % 2 else f"<article>{body}</article><div>outside {n}</div>"
        rows.append((n, f"http://h{host}.example/{n}", f"<html><body>{body}</body></html>"))
    return rows


def brute_texts(rows, least=5, share=0.5):
    """The same by trees: every element's path and content as they are, counted over distinct pages."""
    pages = {}
    for key, url, source in rows:
        elements, blocks = {}, []

        def walk(node, path, around, inside):
            path = path if node.tag in ("html", "body") else f"{path}/{node.tag} {node.get('class', '')} {node.get('id', '')}"
            own = around if node.tag in ("html", "body") else [*around, len(elements)]
            if own is not around:
                elements[own[-1]] = None
            inside = inside or node.tag == "article"
            content = []
            for text in [node.text, *[x for child in node for x in (child, child.tail)]]:
                if text is None:
                    continue
                if not isinstance(text, str):
                    content.append(walk(text, path, own, inside))
                elif text.strip():
                    blocks.append((text, own, inside))
                    content.append(text)
            if own is not around:
                elements[own[-1]] = (path, (path, tuple(content)))
            return (path, tuple(content))

        walk(ElementTree.fromstring(source), "", [], False)
        kept = [b for b in blocks if b[2]] or blocks
        pages[key] = url.split("/")[2], kept, elements
    held, there = {}, {}
    for host, kept, elements in pages.values():
        text = tuple(t for t, _, _ in kept)
        for n in {n for _, around, _ in kept for n in around}:
            path, content = elements[n]
            held.setdefault((host, content), set()).add(text)
            there.setdefault((host, path), set()).add(text)
    out = {}
    for key, (host, kept, elements) in pages.items():
        gone = {n for n, (path, content) in elements.items() if len(held.get((host, content), ())) >= max(least, share * len(there.get((host, path), ())))}
        out[key] = " ".join(t for t, around, _ in kept if not gone & set(around))
    return out


def test_templates_against_trees(spark):
    rows = tree_pages(random.Random(5))
    want = brute_texts(rows)
    assert texts(spark, rows) == want
    assert any("box" not in t for t in want.values()) and any("box" in t for t in want.values()) and any("common" in t for t in want.values())


def test_sentences_that_articles_share_stay(spark):
    """A line on many pages of a host is no template while other articles have other paragraphs in its place; a box on all pages of a section is."""
    box = "<div class='author'><p>Written by us</p></div>"
    rows = [(k, "http://a.example/", f"<article><p>own {k}</p>" + "<p>A common line.</p>" * (k % 3 == 0) + f"<p>end {k}</p>" + box * (k < 20) + "</article>") for k in range(120)]
    assert texts(spark, rows) == {k: f"own {k}" + " A common line." * (k % 3 == 0) + f" end {k}" for k in range(120)}
    # Without the counts the box stays: they, not names, take it away.
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert htmltext.extract(pages, template_pages=1000).filter("text like '%Written by us%'").count() == 20


@pytest.mark.parametrize("source", ["<a " * 200_000, "<a '" * 100_001 + ">", "<div>x" * 60_000, "<blockquote><p>x" * 30_000, "<!--" * 200_000, "<script>" * 100_000, "<p x='>" * 50_001, "</b>" * 100_000, "<i>" * 50_000 + "<h1></h1>" * 50_000, "<" * 500_000, "&" * 300_000])
def test_hostile_pages_take_linear_time(source):
    began = time.perf_counter()
    htmltext.Page(source).kept()
    assert time.perf_counter() - began < 10


def test_deep_nesting_keeps_the_text():
    page = "<article>" + "<div>" * 1000 + "deep" + "</div>" * 1000 + "<p>after</p></article><p>outside</p>"
    assert [t for t, _ in htmltext.Page(page).kept()] == ["deep", "after"]


@pytest.mark.parametrize("page,text", [
    ("<div class='layout with-sidebar'><article>own</article><div class='sidebar'>side</div></div>", "own"),
    ("<div class='content no-sidebar'><p>own</p></div><div class='site-sidebar'>side</div>", "own"),
    ("<div class='page has-nav'><p>own</p><ul class='nav-list'><li>menu</li></ul></div>", "own"),
    ("<article class='post comments-open'><p>own</p><div class='comments'>reader</div></article>", "own"),
    ("<div class='sidebar-page'><main>own<section class='comments'>reader reader</section></main></div><article>other article</article>", "own other article"),
    ("<div class='social'><article>own words</article></div><div class='related'><article>x</article></div>", "own words"),
    ("<div id='widget'><article>own</article><div class='comments'>" + LONG + "</div></div>", "own"),
    ("<div class='widget'><p>" + LONG + "</p></div><p>end</p>", LONG + "end"),
    ("<div><p>own</p></div><div class='comments'><article>a</article><article>b</article></div>", "own"),
    ("<article>own</article><div class='related'><article>" + LONG + "</article></div>", "own"),
    ("<div class='with-header'><p>own</p></div><div class='header'>site</div><div class='cookie-notice'>cookies</div>", "own"),
])
def test_names_do_not_take_the_article(page, text):
    assert " ".join(t for t, _ in htmltext.Page(f"<body>{page}</body>").kept()) == text
