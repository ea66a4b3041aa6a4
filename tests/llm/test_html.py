import html
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import htmltext

SMALL = "/root/testdata/sf0.01"
weights = st.integers(-6, 6)


@settings(max_examples=200, deadline=None)
@given(st.lists(weights, min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 4)), max_size=14))
def test_cut_is_minimal(unary, edges):
    n = len(unary)
    edges = [(i, j, w) for i, j, w in edges if i < n and j < n and i != j]

    def cost(label):
        own = sum(-u if side and u < 0 else u if not side and u > 0 else 0 for u, side in zip(unary, label, strict=True))
        return own + sum(w for i, j, w in edges if label[i] != label[j])

    best = min(cost(x) for x in itertools.product((False, True), repeat=n))
    assert cost(htmltext.minimum_cut(unary, edges)) == pytest.approx(best)


def test_a_long_chain_is_cut_quickly():
    n = 3000
    label = htmltext.minimum_cut([0.4 if i % 2 else -0.2 for i in range(n)], [(i, i + 1, 0.3) for i in range(n - 1)])
    assert all(label)


def test_given_pages():
    import duckdb

    for page, in duckdb.sql(f"select html from '{SMALL}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert htmltext.main_text(page) == " ".join(plain.split())


PAGE = """<!DOCTYPE html><html><head><title>Site &raquo; T</title><style>p{}</style></head><body class="home">
<div id="cookie-notice"><p>We use cookies to make this site as good as it can be, and you accept that, do you not?</p></div>
<header><a href="/">Site</a><form action="/q"><input name=q><button>Search</button></form></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="layout"><aside class=sidebar><h3>Related</h3><p>Another story, told at a length that a paragraph of an article might well have had.</p></aside>
<main><article><header><h1>The <em>head</em>line</h1></header>
<p>First para&shy;graph with a <a href="x">link</a>, &lt;angle&gt; brackets &amp;&nbsp;more &#8212; really.
<p>Short.</p><div class="advert"><p>Buy this now, it is the best thing that you have ever seen in your life, it really is.</p></div>
<script>if (a < b) { document.write("<p>no</p>") }</script><noscript><p>Turn on scripts</p></noscript>
<ul><li>item one</li><li>item two</li></ul><blockquote>Said so.</blockquote><!-- <p>hidden</p> --><pre>x  =
 1</pre></article>
<section id="comments"><h2>Comments</h2><p>I have read this whole article with great care, and I must say that I disagree with it.</p></section></main></div>
<footer><p>&copy; Site, all of whose rights are reserved, and whose text here is long enough to look like prose.</p></footer></body></html>"""


def test_a_page_with_everything():
    assert htmltext.main_text(PAGE) == "The headline First para\u00adgraph with a link, <angle> brackets & more \u2014 really. Short. item one item two Said so. x = 1"


def test_without_an_article_element():
    page = "<body><div><a href=/>Home</a> <a href=/x>About</a></div><div><p>" + "Prose with some length, and a second part. " * 5 + "</p><p>Ok.</p></div><div><a href=/y>Imprint</a></div>"
    assert htmltext.main_text(page) == ("Prose with some length, and a second part. " * 5).strip() + " Ok."


@pytest.mark.parametrize(("page", "text"), [("", ""), ("   ", ""), ("<p></p>", ""), ("<script>x", ""), ("<p>A sentence that stands on its own, unclosed", "A sentence that stands on its own, unclosed"), ("<!-- never closed <p>x</p>", ""), ("Only some plain text, no markup.", "Only some plain text, no markup.")])
def test_broken_pages(page, text):
    assert htmltext.main_text(page) == text


def test_broken_markup_takes_linear_time():
    for page in ("<p class='" * 20000, "<" * 100000, "<a b=\"c" * 20000, "<div>" * 20000 + "x" + "</div>" * 20000, "&amp" * 50000, "<!--" * 50000, "<p>w.</p>" * 20000):
        htmltext.main_text(page)


TEXT = "A sentence that stands on its own in the article, and is of some length, as they are."


@pytest.mark.parametrize("outer", ['class="layout has-sidebar"', 'id="page" class="site nav-fixed"', 'class="no-sidebar header-fixed"', 'class="sidebar"'])
def test_layout_names_around_an_article(outer):
    for tag in ("article", "main"):
        page = f"<body><div {outer}><div><{tag} class='post has-sidebar'><h1>Headline</h1><p>{TEXT}</p><p>Short.</p></{tag}></div><nav><a href=/>Home</a></nav></div>"
        assert htmltext.main_text(page) == f"Headline {TEXT} Short."
    if outer != 'class="sidebar"':
        page = f"<body><div {outer}><div class=entry-content><p>{TEXT}</p><p>{TEXT}</p></div></div>"
        assert htmltext.main_text(page) == f"{TEXT} {TEXT}"
        page = f"<body><div {outer}><div><p>{TEXT}</p><p>{TEXT}</p></div></div>"
        assert htmltext.main_text(page) == f"{TEXT} {TEXT}"


def test_header_words_inside_an_article():
    page = f"<article><div class='article-header'><h1>Headline</h1></div><div class=header><p>By the way.</p></div><p>{TEXT}</p></article><div class=header><p>Site of sites</p></div>"
    assert htmltext.main_text(page) == f"Headline By the way. {TEXT}"


@pytest.mark.parametrize("extra", [f'<section id="comments"><div class="content"><p>{TEXT}</p></div></section>', f'<ol class="comments"><li><article class="comment-body"><p>{TEXT}</p></article></li></ol>', f'<div class="cookie-notice"><p>{TEXT}</p></div>', f'<div class="sidebar"><div class="post"><p>{TEXT}</p></div></div>'])
def test_named_boilerplate_stays_out(extra):
    assert htmltext.main_text(f"<body><article><h1>Headline</h1><p>{TEXT}</p></article>{extra}</body>") == f"Headline {TEXT}"
    assert htmltext.main_text(f"<body><main><h1>Headline</h1><p>{TEXT}</p>{extra}<p>{TEXT}</p></main></body>") == f"Headline {TEXT} {TEXT}"


@pytest.mark.parametrize("size", [1990, 2100, 500_000])
def test_attribute_values_of_any_length(size):
    value = "a > b <i> " * (size // 10)
    text = "A sentence that stands on its own in the article, and is of some length, as they are."
    for quote, other in ("\"'", "'\""):
        page = f"<article><p data-x={quote}{value}{other}{quote} data-y={other}>{other}>{text}</p><img alt={quote}{value}{quote}></article>"
        assert htmltext.main_text(page) == text
    parts = " ".join(f'data-{i}="{i} > 0"' for i in range(size // 10))
    assert htmltext.main_text(f"<article><p {parts}>{text}</p></article>") == text


def test_quotes_that_nothing_closes():
    text = "A sentence that stands on its own in the article, and is of some length, as they are."
    assert htmltext.main_text(f"<article><p class='x>{text}</p></article>") == text
    assert htmltext.main_text(f"<article><p class=it's>{text}</p></article>") == text


def test_odd_quotes_take_linear_time():
    import time

    for page in ("<a \">\" " * 40000, "<a " * 40000 + ">", "<a " * 40000 + "\"" * 3 + ">", "<a '\">' " * 40000 + "'", "<p a='>' b=\">\"" * 30000, "<a \"<a >\" " * 40000, "<a b='" * 40001 + ">"):
        start = time.perf_counter()
        htmltext.blocks_of(page)
        assert time.perf_counter() - start < 10


def test_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5), (3, "w", "<article><p>" + "long text " * 100_000 + "</p></article>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = htmltext.extract(pages).collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    by = {r["page_id"]: r for r in out}
    assert by[2]["text"] == "" and by[None]["text"] == "" and by[3]["n_chars"] == 999_999 and by[1]["text"].startswith("The headline")
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_a_partly_matching_name_inside_an_article():
    long = TEXT + " " + TEXT
    for name in ("share-prices", "search-results-explained", "menu-of-the-day", "ad-hoc-report"):
        page = f"<body><nav><a href=/>Home</a></nav><main><section id='{name}'><h2>Prices rose</h2><p>{long}</p></section></main></body>"
        assert htmltext.main_text(page) == f"Prices rose {long}"
    page = f"<article><p>{TEXT}</p><div class='share-buttons'><a href=x>Tweet</a> <a href=y>Mail</a></div><p>{TEXT}</p></article>"
    assert htmltext.main_text(page) == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- a --!>", "<!---->", "<!-- a -- b -->", "<!--a--!><!--b-->"])
def test_comments_end_as_in_browsers(comment):
    assert htmltext.main_text(f"<article><p>{TEXT}</p>{comment}<p>{TEXT}</p><!-- x --></article>") == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("name", ["discussion", "comment-list", "reader-comments", "responses", "post-discussion", "reactions", "comments"])
def test_readers_comments_inside_an_article(name):
    inside = f"<section class='{name}'><h3>What readers say</h3><p>{TEXT}</p><div><p>I agree with what was said before. {TEXT}</p></div></section>"
    assert htmltext.main_text(f"<body><article><h1>Headline</h1><p>{TEXT}</p>{inside}</article></body>") == f"Headline {TEXT}"
    assert htmltext.main_text(f"<body><article class='post {name}-open'><h1>Headline</h1><p>{TEXT}</p></article></body>") == f"Headline {TEXT}"


@pytest.mark.parametrize("text", ["Some text in a div only", "Ok", "Title of it"])
def test_text_that_is_alone_on_its_page(text):
    for page in (f"<div>{text}</div>", text, f"<html><body><div><div>{text}</div></div></body></html>", f"<nav><a href=/>Home</a></nav><div>{text}</div><footer>&copy; all rights</footer>"):
        assert htmltext.main_text(page) == text
    assert htmltext.main_text("<div><a href=/>Home</a> <a href=/x>About</a></div><div class=cookie-notice><p>We use cookies.</p></div>") == ""
