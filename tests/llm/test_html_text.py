"""op7 on small pages whose main text is known."""

import time

import pytest

from ocellus.llm import html_text as H

LONG = "This paragraph has enough words to be taken for the content of the page, as articles have."
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></nav>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script>{head}</head><body>{body}</body></html>"


def test_article_with_all_around():
    body = (
        f"<header><h1>Site</h1></header>{MENU}<!-- ad --><div class='ad'>Buy {LONG}</div><div id='cookie-notice'>{LONG}</div><article><header><h1>Title &amp; more</h1></header><p><b>{LONG}<br><p>Short.</p>"
        f"<p>a&nbsp;b\n  c</p><aside>Side {LONG}</aside><form><label>Name</label><input></form><ul><li>one<li>two</ul></article><section class='comments'><p>{LONG}</p></section><div class='sidebar'>{LONG}</div><footer>&copy; me</footer>"
    )
    assert H.main_text(page(body)) == f"Title & more\n{LONG}\nShort.\na b c\none\ntwo"


def test_without_article():
    body = f"{MENU}<div id='top'>Hi</div><div class='content'><h2>Head</h2><p>{LONG}</p><p>{LONG} Twice.</p><p>Ok.</p></div><div class='footer'>{LONG}</div>"
    assert H.main_text(page(body)) == f"Head\n{LONG}\n{LONG} Twice.\nOk."


def test_comments_inside_article():
    assert H.main_text(page(f"<article><p>{LONG}</p><div class='comment-list'><article class='comment'><p>{LONG}</p></article></div></article>")) == LONG


def test_text_beside_the_longest_block():
    long = " ".join([LONG] * 22)
    assert H.main_text(page(f"<h1>T</h1><p>short lead</p><p>{long}</p><p>short end</p>")) == f"T\nshort lead\n{long}\nshort end"
    assert H.main_text(page(f"{MENU}<h1>T</h1><p>lead</p><div><p>{long}</p><p>x</p></div><div><ul><li><a href='/'>More</a></ul></div>")) == f"T\nlead\n{long}\nx"
    assert H.main_text(page(f"<div>T</div><div>{long}</div><div>end</div>")) == f"T\n{long}\nend"
    assert H.main_text(page(f"<ul><li>one</li><li>{long}</li></ul><pre>two</pre>")) == f"one\n{long}\ntwo"


def test_every_article_is_kept():
    long = " ".join([LONG] * 22)
    assert H.main_text(page(f"<article><p>Brief.</p></article><article><p>{long}</p></article><div class='ad'><article><p>Buy</p></article></div>")) == f"Brief.\n{long}"
    assert H.main_text(page(f"<div><article><p>Brief.</p></article></div><div><p>{long}</p><p>{long}</p></div>")) == f"Brief.\n{long}\n{long}"


def test_head_without_end_tag():
    assert H.main_text(f"<html><head><title>x</title><meta charset=utf-8><body><article><p>{LONG}</p></article></body></html>") == LONG
    assert H.main_text(f"<head><title>x</title><style>p{{}}</style><div><p>{LONG}</p></div>") == LONG
    assert H.main_text(f"<head><title>x</title><noscript><link></noscript>{LONG}") == LONG
    assert H.main_text(f"<head><noscript><style></style><body><p>{LONG}</p>") == LONG


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "page-with-sidebar", "hasSidebar wide", "sidebar-left", "comments-open"])
def test_wrapper_named_for_what_the_page_has(name):
    inner = f"<div class='sidebar'>Side {LONG}</div><div class='no-js comments'><p>{LONG}</p></div>"
    assert H.main_text(page(f"<div id=page class='{name}'>{inner}<article><p>{LONG} A.</p><p>{LONG} B.</p></article></div>")) == f"{LONG} A.\n{LONG} B."


def test_wrapper_around_most_of_the_text():
    text = f"<p>{LONG} A.</p><p>{LONG} B.</p>"
    assert H.main_text(page(f"<div class='sidebar-left'><div class='sidebar'>Side</div>{text}</div><div>foot</div>")) == f"{LONG} A.\n{LONG} B."
    assert H.main_text(page(f"<form id=f><div class='menu-page'><article>{text}</article></div></form>")) == f"{LONG} A.\n{LONG} B."
    assert H.main_text(page(f"<div>{text}</div><div class='comments'>{f'<p>{LONG}</p>' * 9}</div>")) == f"{LONG} A.\n{LONG} B."
    assert H.main_text(page(f"<div>{text}</div><div class='comments'>{f'<article id=comment-1><p>{LONG}</p></article>' * 9}</div>")) == f"{LONG} A.\n{LONG} B."


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("   ") == H.main_text("<html></html>") == H.main_text(page(MENU)) == ""
    assert H.main_text("plain &lt;text&gt; &#233; &am") == "plain <text> é &am"
    assert H.main_text(f"<article><p>{LONG}</p><p>cut &amp") == f"{LONG}\ncut &"
    assert H.main_text("<p>" * 3000 + LONG) == LONG
    assert H.main_text("<div>" * 3000 + LONG).endswith(LONG)
    assert H.main_text(f"<article><p>{LONG}</p></div></span><p>x</p></article>") == f"{LONG}\nx"
    assert len(H.main_text(page(f"<article>{f'<p>{LONG}</p>' * 5000}</article>")).split("\n")) == 5000


def test_whole_table(spark):
    pages = spark.createDataFrame([(1, "u", page(f"<article><p>{LONG} 🙂</p></article>"), "x"), (None, None, None, "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    got = sorted(H.extract(pages).collect(), key=lambda r: -r.n_chars)
    assert (got[0].text, got[0].n_chars) == (f"{LONG} 🙂", len(LONG) + 2) and [r.text for r in got[1:]] == ["", ""]
    assert H.extract(pages.limit(0)).count() == 0


def test_wrappers_named_for_what_they_hold():
    body = "<h1>Title</h1><p>This is the long article text, with many words in it.</p><p>More of it follows here for sure.</p>"
    want = "Title\nThis is the long article text, with many words in it.\nMore of it follows here for sure."
    for name in ("content no-sidebar", "main ad-free", "post-with-comments", "layout has-sidebar", "article-share", "page-content sidebar"):
        assert H.main_text(f"<html><body><div class='{name}'>{body}</div><div class='sidebar'><p>Other stories to read.</p></div></body></html>") == want, name
    assert H.main_text(f"<body><div class='layout has-sidebar'>{body}<div class='sidebar'><p>Other stories.</p></div></div><div class='post-comments'><p>Nice!</p></div></body>") == want


def test_deep_pages_take_linear_time():
    n = 60_000
    start = time.process_time()
    for page in ("<div>" * n + "x" + "</div>" * n, "<div class=sidebar>x" * n + "</div>" * n, "<header>" * n, "<div class=sidebar>x</div>" * n + "<article><p>words"):
        H.main_text(page)
    assert time.process_time() - start < 30
