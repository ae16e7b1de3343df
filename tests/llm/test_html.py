"""Main text of hand-written pages of several layouts, of attributes that only look like marks, and of deep or broken markup."""

import random
import time

import pytest

from lexispark.llm import html

PROSE = "The river had risen over night, and the ferry did not cross before noon that day."


def kept(page):
    return html.main_text(page).split("\n\n")


@pytest.mark.parametrize(
    "attributes",
    ['title="The hidden valley"', 'data-hidden="false"', 'class="text side-effects"', 'class="comment-on-policy"', 'class="no-sidebar"', "data-class='ad banner'", 'id="footerless"', 'style="color:red" lang=en', 'class="header-image-caption wide"'],
)
def test_attributes_that_are_no_marks(attributes):
    page = f"<article><p>{PROSE} One.</p><p {attributes}>{PROSE} Two.</p><p><a href='/x?id=footer'>Three</a> {PROSE}</p><p>{PROSE} Four.</p></article>"
    assert kept(page) == [f"{PROSE} One.", f"{PROSE} Two.", f"Three {PROSE}", f"{PROSE} Four."]


@pytest.mark.parametrize("attributes", ["hidden", 'style="display: none"', 'aria-hidden="true"', 'class="cookie-notice"', 'class="post-comments"', 'id="relatedPosts"', "role=navigation", "class='widget-area sidebar'", 'class="ad-slot-3"'])
def test_attributes_that_are_marks(attributes):
    page = f"<article><p>{PROSE}</p><div {attributes}><p>Words of no interest here.</p></div><p>{PROSE} End.</p></article>"
    assert kept(page) == [PROSE, f"{PROSE} End."]


@pytest.mark.parametrize("depth", [10, 520, 3000])
def test_depth_is_not_bounded(depth):
    page = "<div>" * depth + "<nav><ul><li>Home and news</li></ul></nav>" + f"<article><h1>Title here</h1><p>{PROSE}</p></article><footer><p>All about us.</p></footer>" + "</div>" * depth
    marks = [b.marks for b in html.blocks_of(page).blocks]
    assert "side" in marks[0] and "content" in marks[1] and "side" in marks[-1]
    assert kept(page) == ["Title here", PROSE]


def test_a_page_within_one_form():
    page = f"""<html><body><form id="aspnetForm" method="post"><div class="masthead"><a href="/">Site</a></div><div class="wrapper"><div class="main-content"><h1>Ferry news</h1>
      <p>{PROSE}</p><p>{PROSE} Second.</p></div></div><label>Search</label><input><button>Go</button><div class="footer">Imprint 2020</div></form></body></html>"""
    assert kept(page) == ["Ferry news", PROSE, f"{PROSE} Second."]
    asking = f"<article><h1>Ferry news</h1><p>{PROSE}</p></article><form class='signup'><p>Leave us your address please.</p><label>Mail</label><button>Send</button></form>"
    assert kept(asking) == ["Ferry news", PROSE]


def test_a_blog_with_comments():
    page = f"""<body class="single post with-sidebar"><div id="header" class="site-header"><h1><a href="/">A blog</a></h1><p class="tagline">Words on water</p></div>
    <ul id="menu-main" class="nav-menu"><li><a href="/a">About</a></li><li><a href="/b">Archive</a></li></ul>
    <div id="content"><div class="post hentry entry"><h2 class="entry-title">The ferry</h2><div class="entry-content"><p>{PROSE}</p><blockquote><p>It was late.</p></blockquote>
    <ul><li>Take the first boat, if there is one.</li><li>Bring a coat.</li></ul><p>{PROSE} &mdash; So it was.</p></div></div>
    <div id="comments" class="comments-area"><h3>2 comments</h3><ol class="comment-list"><li class="comment even"><p>What a fine story this is, thank you for it.</p></li></ol>
    <div id="respond"><form><textarea>x</textarea><button>Post it</button></form></div></div></div>
    <div class="sidebar widget-area"><h3>Recent</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><p>Subscribe to read more of us each week.</p></div>
    <div class="site-footer"><p>Made by hand in 2021.</p></div></body>"""
    assert kept(page) == ["The ferry", PROSE, "It was late.", "Take the first boat, if there is one.", "Bring a coat.", f"{PROSE} — So it was."]


def test_a_page_without_classes():
    page = f"""<html><body><table><tr><td><a href="/1">Home</a></td><td><a href="/2">News</a></td><td><a href="/3">Contact</a></td></tr></table>
    <h1>On ferries</h1><p>{PROSE}</p><p>{PROSE} Again.</p><pre>time  boat
    noon  one</pre><hr><p>{PROSE} Last.</p></body></html>"""
    assert kept(page) == ["On ferries", PROSE, f"{PROSE} Again.", "time boat noon one", f"{PROSE} Last."]


def test_distance_is_that_of_the_tree():
    r = random.Random(1)
    for _ in range(60):
        page = html.blocks_of("".join(r.choice(["<div>", "</div>", "<i>", "</i>", "<p>", "<ul>", "</ul>", "<li>"]) + "w" for _ in range(80)))
        up = lambda a: [a] if not a else [a, *up(page.elements[a].parent)]  # noqa: B023, E731
        for _ in range(40):
            a, b = (up(r.randrange(len(page.elements))) for _ in "ab")
            assert page.distance(a[0], b[0]) == min(a.index(x) + b.index(x) for x in a if x in b)


def test_strange_markup_takes_linear_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "x. " * 10, "<b>" * 50_000 + "</i>" * 50_000 + "text", "<p>" * 50_000 + "</section>" * 50_000, "<div>" * 30_000 + "<p>a</p></section>" * 30_000):
        html.main_text(page)
    assert time.time() - began < 30
    assert html.main_text("<p>a < b and <b>c") == "a < b and c"
