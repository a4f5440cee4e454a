"""Pages written and labelled by hand that no model was trained on: hidden parts, telling names within articles, no article tag."""

import os
import re

import pytest

from poolstrata.llm import html_text

DATA = "/root/testdata/sf0.01/pages.parquet"
P = "<p>The river rises in the hills and runs for forty miles before it meets the sea.</p><p>It is slow.</p>"
Q = "<p>In winter the meadows beside it flood, and swans come down from the north.</p>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer><p>All rights reserved.</p></footer>"
# (before, content, after); what is cut out of content stands between {{ and }}
PAGES = [
    (NAV, f"<article><h1>Rivers</h1>{P}<p hidden>This paragraph of the article is folded away until a reader opens it.</p>{Q}</article>", FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}<p style="display:none">This paragraph of the article is folded away until a reader opens it.</p></article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}<section class="recommended-reading"><p>Of the older books the best is still the survey of the whole valley.</p>{Q}</section></article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}<div class="notice-board"><p>The board by the bridge told travellers when the ford could be crossed.</p>{Q}</div></article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}<div class="bar-chart"><p>The chart shows how high the water stood in each of the last ten years.</p></div>{Q}</article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}<section id="links-with-the-past"><h2>Mills</h2>{Q}</section></article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}{{{{<div class="comments"><p>I have lived here all my life and never saw a swan.</p></div>}}}}</article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}{{{{<div class="related-posts"><h3>More</h3><ul><li><a href="/x">Ten lakes to see</a></li></ul></div>}}}}{Q}</article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}{{{{<div class="newsletter-signup"><p>Sign up for our weekly letter.</p></div>}}}}{Q}</article>', FOOT),
    (NAV, f'<article><h1>Rivers</h1>{P}{{{{<aside><p>See also our guide to the coast.</p></aside>}}}}{Q}</article>', FOOT),
    (NAV + '<div class="cookie-notice" hidden><p>We use cookies to make this site better.</p></div>', f"<article><h1>Rivers</h1>{P}{Q}</article>", FOOT),
    (NAV + '<div id="login-modal" style="display: none"><form><p>Log in with your name and password.</p></form></div>', f"<article><h1>Rivers</h1>{P}{Q}</article>", FOOT),
    ('<div class="header"><p>The Valley Times</p></div>', f'<div class="content"><h1>Rivers</h1>{P}{Q}</div>', '<div class="footer"><p>Imprint and terms</p></div>'),
    ('<div id="navbar"><a href="/">Start</a> <a href="/b">Book</a></div>', f'<div id="main"><h1>Rivers</h1>{P}<ul><li>Trout live in the upper part.</li><li>Eels live in the lower part.</li></ul>{Q}</div>', '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/l">Lakes</a></li></ul></div>'),
    ('<header class="site-header"><h1>The Valley Times</h1></header>', f"<main><h1>Rivers</h1>{P}{Q}</main>", '<section class="comments"><p>Lovely piece, thank you very much for it!</p></section>' + FOOT),
    ('<div class="menu"><ul><li><a href="/">Home</a></li></ul></div>', f'<div class="story"><h2>Rivers</h2>{P}<div class="share-of-water"><p>A third of the water is led off to the fields in a dry year.</p></div>{Q}</div>', '<div class="share-buttons"><a href="#">Post</a> <a href="#">Mail</a></div>'),
    ('<div class="wrap"><div class="topbar"><p>Log in</p></div>', f'<div class="post"><h1>Rivers</h1>{P}<blockquote><p>No one steps in it twice, as they say in the village.</p></blockquote>{Q}</div>', '<div class="comment-list"><p>We went there last year and saw otters!</p></div></div>'),
    ('<form class="search"><input><p>Search the site</p></form>', f'<div class="entry-content"><h1>Rivers</h1>{P}<div hidden><p>The full list of bridges, from the spring down to the mouth of it.</p></div>{Q}</div>', '<div class="widget"><h4>Weather</h4><p>Rain later today.</p></div>'),
    (NAV, f'<article><h1>Rivers</h1>{P}<details><summary>Floods</summary><p>There were three great floods within living memory of the place.</p></details>{Q}</article>', '<div class="promo"><p>Subscribe now and save half the price.</p></div>' + FOOT),
    (NAV, f'<article><h1>Rivers</h1><div class="side-note-on-names"><p>Its name is older than any of the villages that stand on its banks.</p></div>{P}{Q}</article>', '<div class="ad">Cheap boats for all, book today.</div>' + FOOT),
]


def blocks(part):
    return [t for t in (html_text.leaf_text(n) for n in html_text.parse(part, shown_only=False) if n.leaf) if t]


@pytest.fixture(scope="module", params=["table", "examples"])
def model(spark, request):
    if request.param == "table" and not os.path.exists(DATA):
        pytest.skip("the driver's tables aren't here")
    pages = spark.read.parquet(DATA) if request.param == "table" else spark.createDataFrame([], "page_id bigint, url string, html string")
    return html_text.train(pages)


def found_and_wanted(model, page):
    before, content, after = page
    html = f"<html><head><title>t</title></head><body>{before}{re.sub('{{|}}', '', content)}{after}</body></html>"
    return model.text(html).split("\n"), blocks(re.sub("{{.*?}}", "", content))


def test_precision_and_recall_of_characters(model):
    right = found = wanted = 0
    for page in PAGES:
        got, want = found_and_wanted(model, page)
        right += sum(len(b) for b in got if b in want)
        found, wanted = found + sum(map(len, got)), wanted + sum(map(len, want))
    assert right / found >= 0.97 and right / wanted >= 0.97


def test_nothing_of_the_article_is_lost_by_hiding_or_names(model):
    for page in PAGES[:6]:
        got, want = found_and_wanted(model, page)
        assert got == want
