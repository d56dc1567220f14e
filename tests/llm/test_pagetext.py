import html
import re
import time

from wavelens.llm import op06_pagetext as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=x>Home, start.</a></nav><div class="cookie-notice"><p>We use cookies, and more, to do things. Accept?</p></div>
<main><article><h1>Title here</h1><p>First   para, with <b>some</b> text &amp; more. It is long enough, really.</p>
<ul><li>one item<li>two&nbsp;item</ul><p>Short.</p><script>var x = "<p>no</p>";</script>
<blockquote>Quote text, indeed.</blockquote><div class="ad">Buy now, friends! Buy now.</div></article></main>
<section id="comments"><p>User comment, long and punctuated; I disagree strongly with this.</p></section>
<aside>Side stuff</aside><form><label>Mail</label></form><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert op.main_text(PAGE).split("\n") == [
        "Title here", "First para, with some text & more. It is long enough, really.", "one item", "two item",
        "Short.", "Quote text, indeed."]


def test_open_tags_and_bare_text():
    assert op.main_text("<p>a<p><b>b<br>c<p>d") == "a\nb\nc\nd"
    assert op.main_text("plain, no tags.") == "plain, no tags."
    assert op.main_text("a < b & c &lt; d") == "a < b & c < d"
    assert op.main_text("") == op.main_text("<html><nav>x</nav>") == op.main_text("<!-- open <p>x") == ""


def test_paths_select_prose_over_lists():
    links = "".join(f"<div class=l{i % 2}><a>Link {i}</a></div>" for i in range(12))
    prose = "".join(f"<p>Sentence number {i}, with a clause; and more words to read here.</p>" for i in range(8))
    text = op.main_text(f"<body><div>{links}</div><div>{prose}<p>Yes.</p></div></body>").split("\n")
    assert len(text) == 9 and text[-1] == "Yes."


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in op.extract(pages).collect()}
    for p in pages.collect():
        inner = p.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split())
                 for x in re.split(r"</?p>|<br>|</?h1>|</body>|</html>", inner)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long_page = "<article>" + "<p>Some words, again.</p>" * 20_000
    rows = [(1, None, None, "x", 1), (None, "u", "", None, None), (2, "u", PAGE, None, None), (2, "u", PAGE, None, None),
            (3, "v", long_page, None, None), (4, "w", "\x00<<<>>>&#xFFFFFF; &#0;</p></div>", None, None)]
    got = op.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and got[0].text == "" and got[0].n_chars == 0
    assert [r.n_chars for r in got if r.page_id == 3] == [len("Some words, again.") * 20_000 + 19_999]
    assert op.extract(spark.createDataFrame([], schema)).count() == 0


def test_layout_names_around_the_article():
    want = op.main_text(PAGE)
    article = PAGE[PAGE.index("<main>"):PAGE.index("</main>") + len("</main>")]
    for start in ('<div class="content has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="sidebar-layout">',
                  '<div class="widget"><section id="modal">'):
        assert op.main_text(PAGE.replace(article, start + article + "</div>")) == want
    plain = article.replace("main>", "div>").replace("article>", "div>")
    for start in ('<div class="with-sidebar">', '<div class="nav-open">'):
        assert op.main_text(f"<body><div class=sidebar><p>More, here.</p></div>{start}{plain}</div></body>") == want
    story = "<div class=widget><article><p>Story {}, with a clause; and more words to read.</p></article></div>"
    assert op.main_text("<main><h1>All</h1>" + "".join(story.format(i) for i in range(3)) + "</main>").count("Story") == 3
    # a named element with an article of its own beside the page's article stays out
    assert op.main_text(PAGE.replace("</main>", "</main><div class=related><article><p>"
                                     + "Other story, long and longer. " * 99 + "</p></article></div>")) == want


def test_header_of_an_article():
    page = ('<article><header class="entry-header"><h1>Headline</h1></header>'
            '<p>First para, with some text. It is long enough, really.</p></article>')
    assert op.main_text(page).split("\n")[0] == "Headline"
    assert op.main_text(page.replace("article>", "div>")).split("\n")[0] != "Headline"
    page = page.replace("article>", "div>").replace("header>", "div>").replace("<header", "<div")
    assert op.main_text(page).split("\n")[0] == "Headline"


def test_parts_of_class_names_drop_no_article_text():
    page = "<body><article><p>First para, with some text. It is long enough, really.</p>{}</article></body>"
    for start, end in (('<p class="social-issues">', "</p>"), ('<p class="legal-history">', "</p>"),
                       ('<div class="alert-bay-photo"><p>', "</p></div>"), ('<h2 id="notices-of-1848">', "</h2>")):
        assert op.main_text(page.format(f"{start}Kept words.{end}")).endswith("\nKept words.")
    for name in ("share-buttons", "ad", "related-posts", "newsletter-signup", "cookie-notice"):
        assert "Gone" not in op.main_text(page.format(f'<div class="{name}"><p>Gone words, gone.</p></div>'))


def test_page_without_article():
    page = ("<body><div id=content><h2>Title</h2>Some text of the page, as it is.<br>More text, and more of it.</div>"
            "<div>Copyright 2020 by us, all rights reserved.</div></body>")
    assert op.main_text(page) == "Title\nSome text of the page, as it is.\nMore text, and more of it."


def test_malformed_pages_take_linear_time():
    """A megabyte of each: seconds, not hours."""
    n = 1 << 20
    start = time.monotonic()
    for part in ("<a ", "<a \"", "<a \">\"", "<a '", "<p x='>", "<div>x", "<div class=a>x", "</p>", "<button>", "<!--", "<![CDATA[",
                 "<script", "<script>", "<script></script", "<body>", "<h1>x", "<p>x", "<article>x", "<a<a", "<", "&", "<li>x</ul>",
                 "<div class=nav>x", "</div <", "<head><body>"):
        for tail in ("", ">", "\">"):
            op.main_text(part * (n // len(part) // 3) + tail)
    assert time.monotonic() - start < 240
    deep = op.main_text("<div>x" * 100_000)
    assert set(deep) <= set("x\n")
