from __future__ import annotations

from llm_support import docs, no_docs, sf  # noqa: F401

import html as H
import re

import pytest

from sparkwright.llm import catalog, html


def article(page):
    t = re.search(r"<article>(.*)</article>", page, re.S)[1]
    t = re.sub(r"</?(?:b|i|a|em|span)\b[^>]*>", "", t)
    return " ".join(H.unescape(re.sub(r"<[^>]*>", " ", t)).split())


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_query_against_the_marked_article(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = catalog.op5_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_the_mark_is_not_needed(spark, model):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert model.extract(bare) == article(r.html)


PAGE = """<html><head><title>T &amp; U</title><style>p{}</style></head><body><header><h1>Site</h1><div class="menu"><a href=x>One</a>
<a href=y>Two</a></div></header><div id="sidebar"><p>side words here for you to see and read all of them</p></div>
<div class="cookie-notice">We use cookies okay accept all</div><div class="content"><h1>Real &lt;title&gt;</h1>
<p>First <b>bo</b>ld and <a href="a>b">link</a> text.<p>Second &eacute;t&#233; has   spaces<div class="ad">Buy now cheap</div>
<p>Third one here goes on for some words.</p><form><input value=a>Subscribe <button>go</button></form>
<ul><li>item one in the article</li><li>item two too</li></ul><script>var x="<p>no</p>";</script><!-- <p>no --><p>Last.</p></div>
<section class="comments"><h2>Comments</h2><p>I like it a lot and here is a long comment by a reader</p></section>
<footer>&copy; me</footer></body>"""


def test_parts_that_are_no_article_are_left_out(model):
    assert model.extract(PAGE) == (
        "Real <title> First bold and link text. Second été has spaces Third one here goes on for some words. "
        "item one in the article item two too Last.")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<article>Hi</article>", "Hi"), ("<!-- x", ""), ("<script>a", ""),
    ('<p a="b>c">d</p>', "d"), ("<p title='x>y z</p>", "y z"), ("<p>" * 3000 + "x", "x"), ("<p>a &amp;amp; b</p>", "a &amp; b"),
    ("<p>" + "w " * 50_000 + "</p>", " ".join(["w"] * 50_000))])
def test_odd_pages(model, page, text):
    assert model.extract(page) == text


def test_scan_finds_the_best_region():
    m = html.Model(0.0, {"p": 2.0, "li": -2.0}, {}, -0.5)
    pages = ["<p>a b</p><li>x y z</li><p>c d e</p>", "<li>q</li><p>a</p><li>x</li><p>b c d</p><li>z</li>", "<li>a</li>"]
    for p in pages:
        bs = html.blocks(p)
        score = [sum(-0.5 for _ in b.tags) + m.word(b) * len(b.text.split()) for b in bs]
        spans = [(sum(score[i:j]), " ".join(b.text for b in bs[i:j])) for i in range(len(bs)) for j in range(i + 1, len(bs) + 1)]
        best = max(spans, default=(0, ""))
        assert m.extract(p) == (best[1] if best[0] > 0 else "")


@pytest.mark.parametrize("mark", ["article", "div"])
@pytest.mark.parametrize("block", ["<aside>{}</aside>", "<form>{}<input><input></form>", '<div class="ad">{}</div>',
                                   '<section class="comments">{}</section>'])
def test_long_hidden_blocks_inside_the_article(model, mark, block):
    lead, tail = "lead words of the article stand here", "and the tail of it ends here"
    beside = block.format("<p>words that are no article text</p>" * 200 + "<div></div>" * 200)
    page = f"<body><{mark}><h1>Head line</h1><p>{lead}</p>{beside}<p>{tail}</p></{mark}></body>"
    assert model.extract(page) == f"Head line {lead} {tail}"


BODY = "<h1>Head line</h1><p>some words of the article stand here for all to read</p><p>and some more of them stand here</p>"
TEXT = "Head line some words of the article stand here for all to read and some more of them stand here"


@pytest.mark.parametrize("name", ["main-nav", "main-menu", "article-comments", "post-comments", "comment-body", "entry-footer",
                                  "sidebar-content", "related-posts", "share-buttons", "article-share", "search-box"])
@pytest.mark.parametrize("mark", ["<article>{}</article>", '<div class="content">{}</div>'])
def test_content_parts_do_not_cancel_what_a_name_says(model, name, mark):
    beside = "<p>words that are no article text but many</p>" * 5
    for kind in ("id", "class"):
        part = f'<div {kind}="{name}">{beside}</div>'
        assert model.extract(f"<body>{part}{mark.format(BODY)}{part}</body>") == TEXT
    assert not any(b.marked for b in html.blocks(f'<div id="{name}">{beside}</div>'))


@pytest.mark.parametrize("page", [
    '<article class="long-form">{}</article>', '<div class="long-form">{}</div>', '<div class="search-results"><article>{}</article></div>',
    '<div class="search-results">{}</div>', '<div class="form"><main>{}</main></div>', '<form id="aspnetForm"><article>{}</article></form>',
    '<div class="content-with-sidebar">{}</div>', '<div class="sidebar-layout"><div role="main">{}</div></div>',
    '<div class="sidebar-layout"><article>{}</article></div>', '<main class="widget">{}</main>'])
def test_names_do_not_hide_the_article(model, page):
    assert model.extract(f"<body>{page.format(BODY)}</body>") == TEXT


def test_articles_of_readers_and_cards_stay_out(model):
    more = "<article class='comment-body'><p>I like it a lot and say so at length</p></article>" * 9
    cards = "<article><p>another story that you may like</p></article>" * 9
    for mark in ("article", "main"):
        page = f"<{mark}>{BODY}</{mark}><aside>{cards}</aside><div class='related'>{cards}</div><div id='comments'>{more}</div>"
        assert model.extract(page) == TEXT


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>a b c</p>"), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as name", "3 as n")
    assert sorted(((r.page_id, r.url, r.text) for r in html.extract_pages(df).collect()), key=str) == sorted(
        [(1, None, ""), (None, "u", "a b c"), (2, "u", ""), (2, "u", "")], key=str)
    assert html.extract_pages(df.limit(0)).collect() == []


def test_stray_end_tags_and_deep_nesting_take_linear_time():
    import time
    page = "<article><p>" + "<div>" * 20_000 + "deep words here" + "</b>" * 20_000 + "</article>"
    start = time.process_time()
    out = html.blocks(page)
    assert [b.text for b in out] == ["deep words here"] and time.process_time() - start < 3


def test_limits_keep_outer_elements_open():
    page = "<ul><li>one<ul><li>two<li>three</ul>four<li>five</ul><p>six<button><div>x</div></button>seven<div>eight</div>"
    assert [b.text for b in html.blocks(page)] == ["one", "two", "three", "four", "five", "six", "x", "seven", "eight"]
