"""Main text of pages: templates of several kinds, cut and hostile markup, edge cases."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from claimloom.llm import html_text
from claimloom.llm.html_text import labelled, text_of

P = "This is a paragraph of the article with a fair number of words in it, so that it counts."
CASES = {
    'div': ('<html><head><title>T</title></head><body><div id="top-nav"><a href="/">Home</a> <a>About</a></div><div class="wrap"><div class="content"><h1>Title</h1><p>{P}</p><p>Short.</p><p>{P}</p></div><div class="sidebar"><h3>Related</h3><p>{P}</p></div></div><div id="comments"><p>{P}</p></div><div class="footer">(c)</div></body></html>', 'Title {P} Short. {P}'),
    'header': ('<body><header><h1>Site name</h1><p>{P}</p></header><main><article><header><h1>Title</h1><p class="byline">By X</p></header><p>{P}</p><aside>{P}</aside><form><label>Mail</label><input></form><article class="comment"><p>{P}</p></article><p>Yes.</p></article><section class="comments"><h2>3 comments</h2><p>{P}</p></section></main><footer>{P}</footer>', 'Title {P} Yes.'),
    'unlabelled': ('<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h2>A title</h2><p>{P}<p>{P}</p><p>End</p></div><ul><li><a>Three</a></li></ul></body>', 'A title {P} {P} End'),
    'unclosed ad': ('<body><div class="ad">Buy<article><h1>T</h1><p><b>{P}<br><p>x&nbsp;y &lt;z&gt; &#233;</article><footer>f</footer>', 'T {P} x y <z> é'),
    'notice': ('<body><div class="cookie-notice"><p>{P}</p><button>OK</button></div><article class="post has-sidebar"><p>{P}</p><div class="ad-slot">ad</div><p>a<i>b</i>c <span class="advert">no</span>d</p><table><tr><td>1<td>2<tr><td>3</table><ul><li>i1<li>i2</ul></article><div role="complementary">{P}</div>', '{P} abc d 1 2 3 i1 i2'),
    'script': ('<body><script>var t="</p><article>no</article>";</script><article><p>{P}</p><script>x()</script><style>p{}</style><noscript>no</noscript><!-- <p>no</p> --><p>a', '{P} a'),
    'empty': ('<html><body><nav><a>x</a></nav><footer>y</footer></body></html>', ''),
    'text': ('just text', 'just text'),
    'teasers': ('<body><main><article><h1>T</h1><p>{P}</p><p>{P}</p><p>{P}</p></article><div class="related"><article><h3>Other</h3><p>{P}</p></article></div></main>', 'T {P} {P} {P}'),
    'newline': ('<body>\n<article>\n<h1>A\n b</h1>\n\n<p>c\td &amp;amp; e</p>\n</article>\n</body>', 'A b c d &amp; e'),
    'tiny': ('<body><nav><ul><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li><li><a href="/x">A long menu entry of words</a></li></ul></nav><div class="ad">{P}</div><article><h1>Hi.</h1><p>Ok.</p></article><footer>{P}</footer>', 'Hi. Ok.'),
    'page attrs': ('<body class="home nav-open"><div id="page"><div class="header-wrap"><div class="logo">L</div></div><div class="post-content"><p>{P}</p><blockquote><p>q</p></blockquote><pre>code  here</pre></div><div class="comment-body"><p>{P}</p></div></div>', '{P} q code here'),
}


@pytest.mark.parametrize("name", CASES)
def test_templates(name):
    page, want = (x.replace("{P}", P) for x in CASES[name])
    assert text_of(page) == want


def test_pages_cut_anywhere():
    """Of a page that ends in its article, all whole text up to there comes out and no markup."""
    page = f"<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p class='x'>{P}</p><p><b>Bold</b> text</article>"
    whole = text_of(page)
    assert whole == f"Title {P} Bold text"
    for cut in range(page.index("<article>") + 9, len(page)):
        got = text_of(page[:cut])
        assert whole.startswith(got) and "<" not in got and "class" not in got
        assert got == " ".join(re.sub("<[^>]*>", " ", re.sub("<[^>]*$", "", page[page.index("<article>") : cut])).split())


def test_labels():
    for name in ("ad", "ad-slot", "sideBar", "sidebar", "main-nav", "comment-list", "commentlist", "cookie_notice", "site footer", "article-footer", "postComments"):
        assert labelled(name), name
    for name in ("", "content", "no-sidebar", "has-ads", "adapter", "heading", "shaded", "post-body", "navy", "footnote"):
        assert not labelled(name), name


def test_hostile_markup_takes_linear_steps():
    began = time.time()
    n = 30_000
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<div>" * n + "x" + "</div>" * n, "<article><p>x</p>" * n, "<" * n, "&" * n, "<!--" * n, "<a " * n, "<a b='" * n, "<ul><li>" * n, "<![x[" * n, "<![CDATA[x]]>" * n):
        text_of(page)
    assert time.time() - began < 60
    assert text_of("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_smoothing_keeps_constants():
    import numpy as np

    assert np.allclose(html_text.smoothed(np.full(9, 5.0), 1.0), 5) and np.allclose(html_text.smoothed(np.array([3.0]), 2.0), 3)


def test_rows(spark, tmp_path):
    """Null, empty, repeated and very long pages, null ids and urls, clashing columns, an empty table; every row's text from the pages' own articles."""
    article = lambda k: f"<article><h1>T{k}</h1><p>{P}<p>été &amp;amp; &quot;{k}&quot;</p></article>"
    rows = [(1, "http://a", None), (2, None, ""), (3, "u", " \n "), (4, "u", article(4)), (4, "u", article(4)), (None, "u", article(5)), (6, "u", f"<article>{'<p>word</p>' * 30_000}</article>")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text int, n_chars int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = html_text.op13_html_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, " ".join(html.unescape(re.sub("<[^>]*>", " ", h or "")).split())) for i, u, h in rows]
    assert sorted(map(str, ((*w, len(w[2])) for w in want))) == sorted(str(tuple(r)) for r in got.collect())
    assert html_text.main_text(pages.limit(0)).count() == 0
    assert got.where(F.col("n_chars") > 0).count() == 4
