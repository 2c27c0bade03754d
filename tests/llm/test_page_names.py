"""Names and styles that say how a part is laid out do not take the main text away."""

import pytest

from tidegate.llm import html

TEXT = "The text of some length stands here, as it should, and goes on for a while."
PART = f"<p>{TEXT}</p>"
LONG = "Here stands the story itself, which is longer than what readers say of it, and it goes on and on. " * 3


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', "style='overflow-x: hidden'", 'href="/a/hidden/b"', 'title="The hidden valley"', 'data-hidden="x"', 'title="display: none"',
    'class="content with-sidebar"', 'class="has-comments"', 'class="no-sidebar"', 'class="page-header-fixed"', 'class="social-policy"', 'title=\'class="ad"\'',
    'class="menu-open"', 'class="related-work"',
])
def test_kept(attributes):
    assert html.extract(f"<body><div {attributes}>{PART}</div></body>") == TEXT
    both = html.extract(f"<body><div {attributes}>{PART}</div><div>{PART}{PART}</div></body>")
    assert both == "\n".join([TEXT] * 3)


def test_wrapper_of_the_text():
    for name in ("sidebar-left", "comments", "social", "ad"):
        assert html.extract(f'<body><div id="{name}"><main>{PART}</main></div><p>x</p></body>') == TEXT
        if name != "comments":  # what readers say is no text of the page, even alone
            assert html.extract(f'<body><div class="{name}"><article>{PART}</article></div></body>') == TEXT
            assert html.extract(f'<body><div class="{name}">{PART}</div></body>') == TEXT


@pytest.mark.parametrize("name", ["comments", "comment-thread", "post-comments", "disqus_thread", "user-comments-list", "comment-area"])
def test_comments_go_however_long_they_are(name):
    said = "".join(f"<article><p>{LONG}</p></article><p>{LONG}</p>" for _ in range(3))
    assert html.extract(f"<body><div id=content><p>Short text here.</p></div><div class='{name}'>{said}</div></body>") == "Short text here."
    assert html.extract(f"<body><article>{PART}<section id='{name}'>{said}</section></article></body>") == TEXT


CONTAINERS = """<body><div class="menu"><a href="/">home</a> <a href="/b">all of the blog</a></div><div class="wrap"><h1>Title of it</h1>
<div><p>{0}</p></div><div><p>{1}</p><ul><li>one thing that counts</li><li>another, longer thing</li></ul></div></div>
<div><a href="/1">Other story with a long headline to read next</a><a href="/2">A second story with such a headline as well</a>
<a href="/3">The third of them is even longer than the others are</a></div><div class="footer">{0}</div></body>"""


def test_pages_without_article_or_main():
    """The density decides: text in several containers stays whole, parts that are links go."""
    got = html.extract(CONTAINERS.format(LONG.strip(), TEXT * 2))
    assert got == "\n".join(["Title of it", LONG.strip(), TEXT * 2, "one thing that counts", "another, longer thing"])


@pytest.mark.parametrize("page", [
    "<b>" * 60_000 + "<p>x" * 60_000, "<div>" * 60_000 + "</article>" * 60_000, "<header>" * 60_000 + "text", "<b><table><td>" + "<i>" * 60_000 + "</b>" * 60_000,
    "<li>" * 60_000 + "<ul>" * 60_000 + "<li>" * 60_000, "<div class=comments>" * 30_000 + "x", "<a>" * 60_000 + "</div><tr>" * 30_000,
])
def test_deep_pages_take_seconds(page):
    import time

    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 20


def test_body_and_html():
    for attributes in ('style="overflow-x: hidden"', 'style="visibility:hidden"', "class=sidebar"):
        assert html.extract(f"<html {attributes}><body {attributes}>{PART}</body></html>") == TEXT


@pytest.mark.parametrize("attributes", [
    "hidden", 'hidden=""', "HIDDEN=hidden", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; Display : none !important"', "style=visibility:hidden",
    'class="ad"', 'class="x sidebar"', 'id="comments"', 'class="cookie-notice"', 'class="comment-list"', 'id="siteFooter"', 'class="widget-area"', "role=navigation",
    'class="post-comments"', 'class="ad-300x250"',
])
def test_left_out(attributes):
    assert html.extract(f"<body><div><p>{LONG}</p></div><div {attributes}>{PART}</div></body>") == LONG.strip()
    article = f"<body><div><article><p>{LONG}</p></article></div><div {attributes}><article>{PART}</article></div></body>"
    assert html.extract(article) == LONG.strip()
    assert html.extract('<body><div aria-hidden="false"><article>' + PART + "</article></div></body>") == TEXT


def test_hidden_part_around_all():
    assert html.extract(f"<body><div hidden><article>{PART}</article></div><p>Short.</p></body>") == "Short."
