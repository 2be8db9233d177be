from __future__ import annotations

import math
import random
import time

from corpusloom.llm.html_extract import density, extract, extract_pages, parse, weigh

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad banner">Buy now, this is a very long advert text that goes on and on and on.</div><aside>Side</aside>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;part<br>goes on<p>Second <a href="x">link</a>
 text</p><form><input value="x"><button>Send</button></form><ul><li>One<li>Two</ul><p>&lt;tag&gt; &eacute; &#x41;</p>
<div id="comments"><div class="comment"><p>Reader says something quite long about this article.</p></div></div></article>
<div class="cookie-notice">We use cookies.</div><footer>&copy; site</footer></body></html>"""


def test_article():
    assert extract(PAGE).split("\n\n") == ["Head & line", "First part goes on", "Second link text", "One", "Two", "<tag> é A"]


def test_density_finds_the_text_without_an_article():
    text = "This is a sentence of the story that is told here at some length. " * 4
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><p>{text}</p><p>Short.</p><p>{text}</p></div><div><a href=4>More</a></div>"
    assert extract(page) == f"{text.strip()}\n\nShort.\n\n{text.strip()}"


def test_odd_pages(spark):
    odd = [None, "", "<html></html>", "<p>unclosed <b>bold", "plain text", "<div" * 50, "<p>a</p></div></p></b><p>b", "<script>never closed", "<p title='>'>x</p>", "<article>" * 2000 + "deep", "<p>" + "long " * 200_000, "a < b and c > d", "<![CDATA[x & y]]>"]
    rows = [(i, None if i == 3 else f"u{i}", h, 1) for i, h in enumerate(odd)] + [(None, "u", "<p>z</p>", 1)]
    got = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    text = {r.page_id: r.text for r in got}
    assert all(r.n_chars == len(r.text) for r in got)
    assert [text[i] for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 12)] == ["", "", "", "unclosed bold", "plain text", "a\n\nb", "", "x", "deep", "x & y"]
    assert len(text[10]) == 200_000 * 5 - 1 and text[None] == "z" and text[11] == "a < b and c > d"
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_articles_within_an_article():
    page = """<main><article><div class="entry-header"><h1>Title</h1></div><p>The text of the story.</p></article>
    <section><article class="comment"><p>A reader's long remark about the story and much else besides.</p></article></section></main>"""
    assert extract(page) == "Title\n\nThe text of the story."


def test_boilerplate_without_end_tags():
    story = "The first part of the story is told here at length."
    for page, want in (
        (f'<article><p class="notice">Mind this.<p>{story}<p>Then more.</article>', [story, "Then more."]),
        (f'<p class="notice">Mind this.<p>{story}</p><p>Then more.</p>', [story, "Then more."]),
        (f'<article><p class="notice">Mind <b>this</b>.<h2>Head</h2><p>{story}</p></article>', ["Head", story]),
        (f'<article><ul><li class="share">Share<ul><li>a</li><li>b</ul><li>{story}</ul><p>Then more.</p></article>', [story, "Then more."]),
        (f'<article><div><ul><li class="share">Share</ul></div><p>{story}</p></article>', [story]),
        (f'<article><dl><dt class="share">Share<dd>{story}</dl></article>', [story]),
        (f'<article><table><tr><td class="share">Share<p>it<td>{story}<tr><td>Then more.</table></article>', [story, "Then more."]),
        (f'<article><table><tr class="share"><td>Share<table><tr><td>x<tr><td>y</table><tr><td>{story}</table></article>', [story]),
        (f'<article><p class="notice">Mind this.</p><p>{story}</p></article>', [story]),
    ):
        assert [t for t in extract(page).split("\n\n") if t] == want, page


STORY = "The story is told here at some length, and it has more to say than any menu. " * 3


def plain_density(node, share):
    """The formula over a walk of the whole subtree, for each node anew."""

    def walk(x, in_link):
        for item in x.items:
            if isinstance(item, str):
                n = len(" ".join(item.split()))
                got[0] += n
                got[2] += n if in_link else 0
            else:
                linked = in_link or item.tag == "a" or item.marked
                got[1] += 1
                got[3] += linked
                walk(item, linked)

    got = [0, 0, 0, 0]
    walk(node, node.tag == "a" or node.marked)
    c, t, lc, lt = got
    if not c:
        return 0.0, got
    c, t, lc_, lt = c, max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc_ + share * c + math.e)
    return c / t * math.log((c / lc_) * (t / lt), base), got


def test_density_by_the_formula():
    rng = random.Random(5)
    for _ in range(60):
        parts = [rng.choice(["<p>", "</p>", "<div>", "</div>", "<a href=1>", "</a>", "<b>", "</b>", "<ul><li>", "</ul>", "<div class=ad>", "<nav>", "</nav>", "word and word ", "<br>"]) for _ in range(80)]
        root = parse("".join(parts))
        order = weigh(root)
        share = root.link_chars / max(1, root.chars)
        for node in order:
            want, counts = plain_density(node, share)
            if not any(_up(node)):  # text in a link counts as a link's whatever stands in it
                assert math.isclose(node.density, want, rel_tol=1e-9, abs_tol=1e-9) and (node.chars, node.link_chars) == (counts[0], counts[2])
            assert math.isclose(node.total, sum(k.density for k in node.kids))
    assert density(100, 0, 0, 0, 0.0) > density(100, 5, 0, 0, 0.0) > density(100, 5, 90, 5, 0.5) > density(100, 5, 100, 5, 0.5) == 0


def _up(node):
    while (node := node.up) is not None:
        yield node.tag == "a" or node.marked


MENU = "".join(f"<li><a href=/{i}>Topic number {i}</a></li>" for i in range(30))


def test_density_drops_menus_without_a_name():
    for page in (
        f"<ul>{MENU}</ul><article><h1>Head</h1><p>{STORY}</p><p>End.</p></article>",
        f"<article><h1>Head</h1><ul>{MENU}</ul><p>{STORY}</p><p>End.</p><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Shop</a></div></article>",
        f"<div><h1>Head</h1><div><ul>{MENU}</ul></div><div><p>{STORY}</p><p>End.</p></div></div>",
        f"<div><p>Us and them.</p></div><article><h1>Head</h1><p>{STORY}</p><p>End.</p></article><p>All rights reserved.</p>",
    ):
        assert extract(page).split("\n\n") == ["Head", STORY.strip(), "End."], page
    links = f"<article><p>{STORY}<a href=1>One</a></p><p><a href=2>Read the report</a></p></article>"
    assert extract(links) == f"{STORY}One\n\nRead the report"
    parts = "".join(f"<section><h2>Part {i}</h2><p>{STORY}</p><p>Short {i}.</p></section>" for i in range(3))
    assert extract(f"<div><h1>Head</h1>{parts}</div>").count("Short") == 3 and extract(f"<body><article>{parts}</article></body>").count("Part") == 3


def test_attributes_as_browsers_read_them():
    for tag in ('<a href="x"">', "<a data-x=it's>", '<a title="a > b">', "<a title='it\"s'>", '<a "x">', "<a =x>", "<a href = x/>", '<a href="x"class=y>', "<a x=`>", '<a href="never closed>'):
        assert extract(f"<article><p>Before {tag}link</a> after, {STORY}</p><p>More of it.</p></article>") == f"Before link after, {STORY.strip()}\n\nMore of it.", tag
    assert extract(f"<article><p>İ<script>no</SCRIPT>{STORY}</p></article>") == "İ" + STORY.strip()
    assert extract("<p>a<!-->b<!--->c<!-- x --!>d</>e</ f>g<?h?>i</p>") == "abcdegi"


def test_names_are_whole_names():
    for name in ("social-history", "legal-analysis", "share-prices", "widget-making", "copyright-law", "adrift", "commentary", "notice-of-motion"):
        assert extract(f'<article><p>Start.</p><div class="{name} x"><p>{STORY}</p></div></article>') == f"Start.\n\n{STORY.strip()}", name
    for name in ("ad", "ad-slot-3", "AdBanner ad", "cookie-notice", "comment-list", "site-footer", "js-share-buttons", "sidebar"):
        assert extract(f'<article><p>{STORY}</p><div class="{name}"><p>Other words, and many of them, for sale.</p></div></article>') == STORY.strip(), name


def test_time_is_linear():
    def seconds(page):
        began = time.perf_counter()
        extract(page)
        return time.perf_counter() - began

    for make in (lambda n: "<div>" * n + "x", lambda n: "<b>" * n + "</i>" * n, lambda n: "<div" * n, lambda n: '<p a="' * n, lambda n: "<li>" * n, lambda n: "<main>" + "<ul><li>" * n + "x y", lambda n: "<td><p><span class=ad>" * n):
        small = min(seconds(make(10_000)) for _ in range(2))
        assert seconds(make(40_000)) < 12 * small + 0.2
