"""HTML extraction: malformed pages in linear time, marks within articles, and lines against the standard library's parser."""

import html.parser
import os
import re
import time

import pytest

from factorloom.llm import html_text
from factorloom.llm.html_text import ARTICLE, lines_of, main_text

SF = "/root/testdata/sf0.01"
STRAY = {
    "open": "<a", "space": "<a ", "quote": '<a "', "quoted end": '<a ">', "two quotes": "<a \"'>", "declaration": "<!", "end": "</", "div": "<div>", "stray end": "<div></span>", "item": "<li>", "half value": '<p a="x>',
    "script": "<script>", "reference": "&", "number": "&#1", "paragraph": "<p>x</p>",
}


@pytest.mark.parametrize("name", sorted(STRAY))
def test_malformed_pages_take_linear_time(name):
    piece = STRAY[name]

    def seconds(n):
        began = time.perf_counter()
        main_text(piece * (n // len(piece)))
        return time.perf_counter() - began

    seconds(10_000)
    assert seconds(400_000) < max(0.2, 10 * min(seconds(100_000) for _ in range(2)))


def test_deep_and_stray_structures_take_linear_time():
    began = time.perf_counter()
    n = 30_000
    main_text("<ul>" + "<div>" * n + "<li>x</li>" * n)
    main_text("<code>" * n + "<hr>" * n)
    main_text("<div>" * n + "</span></p></b>" * n)
    main_text("&#" + "9" * 10_000 + "; &#" + "0" * 10_000 + "65;" + '<p title="' + "x" * 100_000)
    assert time.perf_counter() - began < 10
    assert main_text("a < b, <3 and <a") == "a < b, <3 and <a" and main_text("&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;") == "�A"


@pytest.mark.parametrize("page, text", [
    ('<article class="post promo"><p>Main</p></article>', "Main"), ('<p>Top</p><article class="sponsored">Main</article>', "Main"), ('<main class="alert" id="menu"><p>Main</p></main>', "Main"),
    ('<article><p>a</p><div class="login">how to login</div><div class="alert">mind</div><ul class="menu"><li>soup</li></ul></article>', "a\nhow to login\nmind\nsoup"),
    ('<article><p>a</p><ul class="menu"><li><a href="x">Home</a></li></ul><div class="comments"><p>First!</p></div><nav>n</nav></article>', "a"),
    ('<div class="login">the only one</div>', "the only one"), ('<main><p>intro</p><article class="teaser"><p>Main</p></article></main>', "Main"),
    ('<article><p>Main</p></article><ol class="comment-list"><li><article class="comment"><p>First!</p></article></li></ol>', "Main"),
    ('<p title="a > b">x</p>', "x"), ("<p title='<b>'>x</p>y", "x\ny"), ('<p class="x>broken</p><p>y', "broken\ny"), ("", ""), (" \n", ""),
])
def test_marks_alone_do_not_take_articles(page, text):
    assert main_text(page) == text


def test_neighbours_decide_on_suspect_lines():
    page = '<article><p>own</p><div class="alert"><p>Sale until May</p></div><p>Shared prose.</p></article>'
    near = [html_text._hash(x) for x in ("Sale until May", "Shared prose.")]
    assert main_text(page) == "own\nSale until May\nShared prose." and main_text(page, [near]) == "own\nShared prose."


class Reader(html.parser.HTMLParser):
    """Lines and whether they are in an article, read another way: breaks at the tags of blocks, silence in scripts."""

    BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.article, self.silent = [], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.article > 0))

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        self.article += tag == "article"
        self.silent += tag in ("script", "style", "title", "textarea", "button", "select")
        if tag in ("br", "td", "th"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        self.article -= tag == "article"
        self.silent -= tag in ("script", "style", "title", "textarea", "button", "select")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_against_the_standard_parser(spark):
    """All given pages: the same lines, and for pages with an article just its lines, less what an element that is no text of the article holds."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        reader = Reader()
        reader.feed(r["html"])
        reader.close()
        reader.flush()
        got = lines_of(r["html"])
        assert [x for x in reader.lines if x[1]] == [(t, True) for t, inside, _, _ in got if inside & ARTICLE]
        assert {t for t, _, _, _ in got} <= {t for t, _ in reader.lines}
        bare = re.sub(r"(?s)<(nav|aside|footer|form)\b.*?</\1>", "", r["html"])
        other = Reader()
        other.feed(bare)
        assert main_text(r["html"]) == "\n".join(t for t, inside in other.lines if inside)
