"""Main texts of planted pages."""

import time

from siltstone.llm import html

MENU = "<div class='x1'><a href=/>Home</a> <a href=/b>News</a> <a href=/c>About</a></div>"


def texts(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.row.page_id: r.text for r in html.extract(df, **options).collect()}


def test_markup_and_references(spark):
    page = "<title>no</title><nav>no</nav><article><h1>A&nbsp;&amp; B</h1><p>one\n two<br>three<p>four <script>no</script><!-- no --><b>five</b><form><label>no</label></form></article><footer>no</footer>"
    assert texts(spark, [(1, "http://a.b/", page), (2, None, None), (3, None, ""), (4, "x", "plain")]) == {1: "A & B\none two three\nfour five", 2: "", 3: "", 4: "plain"}


def test_content_that_sounds_like_boilerplate_stays(spark):
    page = "<article><section id='related-work'>A</section><p class=alert>B</p><div class='article-header'>C</div><p>x <b class=search>D</b> <label>E</label></article>"
    assert texts(spark, [(1, "http://a.b/", page)]) == {1: "A\nB\nC\nx D E"}


def test_named_boilerplate_goes(spark):
    bad = ["cookie-banner", "ad", "site-header", "sidebarLeft", "comment-list", "newsletter signup", "share_buttons", "breadcrumbs"]
    page = "<body><main><p>text</p>" + "".join(f"<div class='{c}'>no {k}</div>" for k, c in enumerate(bad)) + "<aside>no</aside></main></body>"
    assert texts(spark, [(1, "http://a.b/", page)]) == {1: "text"}


def test_unmarked_templates_by_host(spark):
    """A menu, a notice and a footer without any telling mark recur on one host; on another the same notice is an article's own."""
    pages = [(i, f"http://a.b/{i}", f"<body>{MENU}<div><p>article {i} of its own</p><p>a quote that all have</p><div>We changed our terms.</div></div><table><tr><td>imprint</td></tr></table></body>") for i in range(12)]
    pages.append((99, "http://c.d/", "<body><div><p>other</p><div>We changed our terms.</div></div></body>"))
    found = texts(spark, pages)
    assert found == {i: f"article {i} of its own\na quote that all have" for i in range(12)} | {99: "other\nWe changed our terms."}
    # the same where templates are too many to broadcast
    assert texts(spark, pages, most=0) == found


def test_repeated_pages_make_no_template(spark):
    pages = [(i, "http://a.b/same", "<body><div><p>copied</p></div></body>") for i in range(50)] + [(99, "http://a.b/", "<body><div><p>other</p></div></body>")]
    assert texts(spark, pages) == {i: "copied" for i in range(50)} | {99: "other"}


def test_deep_and_broken_pages_take_linear_time():
    sources = ["<div>" * 20_000 + "deep" + "</p>" * 20_000, "<p>" + "<b>" * 20_000 + "x" + "</i>" * 20_000, "<article>" * 20_000 + "q", "<ul>" + "<li>x" * 20_000]
    for s in sources:
        began = time.time()
        page = html.Page(s)
        page.subtrees(b"")
        assert page.text()
        assert time.time() - began < 5


def test_whole_sample(spark):
    """Every article of the pages given, word by word."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.row.html, re.S)[1]
        assert html.unescape(re.sub(r"<[^>]*>", " ", article)).split() == r.text.split()
