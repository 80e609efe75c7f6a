import random
import re
from html.parser import HTMLParser

import pytest

from stintwise.llm import main_text as M

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"
WORDS, TAGS = M.scores({})


class Article(HTMLParser):
    """The text in `article`, by the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.found = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.space(tag)

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.space(tag)

    def space(self, tag):
        if tag not in M.INLINE:
            self.found.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.found.append(data)


def article(page):
    return " ".join("".join(Article(page).found).split())


def test_equals_the_marked_article_of_every_given_page(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = sorted((r["page_id"], r["url"], article(r["html"])) for r in pages.collect())
    got = sorted((r["page_id"], r["url"], r["text"]) for r in M.main_texts(pages).collect())
    assert got == want and len(want) == 50


def test_weights_from_labelled_pages_find_articles_that_are_not_marked(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    words, tags = M.weights(pages)
    for r in pages.collect():
        bare = re.sub(r"</?article>", "", r["html"])
        boxed = re.sub(r"<(/?)article>", r"<\1div>", r["html"])
        assert M.extract(bare, words, tags) == M.extract(boxed, words, tags) == article(r["html"])


PROSE = "The river rose in the night and the town moved its market to the upper square."
MORE = "By noon the stalls were open again, and nobody spoke of the water any more."

LAYOUTS = {
    "menus, adverts and comments": f"""<body><header><h1>Daily Site</h1><nav><ul><li><a href=/>Home</a>
        <li><a href=/x>World news and more</a></ul></nav></header>
        <div id="cookie-notice">We use cookies to make this site better for all of you.</div>
        <div class="wrap has-sidebar"><div class="post"><h2>High water</h2><p>{PROSE}</p>
        <div class="ad-slot">Buy boats now, the best boats in town, only this week, hurry up!</div>
        <p>{MORE}</p></div>
        <div class="sidebar"><p>Most read: a long list of other stories from this week.</p></div></div>
        <section id="comments"><p>I was there and it was not like that at all, said a reader.</p></section>
        <form><label>Your mail</label><p>Send us what you know about the town and its river.</p></form>
        <footer><p>All rights reserved by the paper, its owners, and others.</p></footer></body>""",
    "main in a form, title before the article": f"""<form id=aspnet><div class="page sidebar-left"><main>
        <h1>High water</h1><article><p>{PROSE}<p>{MORE}</article>
        <section class="related-posts"><article><p>Another story that is not of this page.</p></article></section>
        </main></div></form>""",
    "upper case, no end tags, odd quotes": f"""<BODY><UL CLASS=menu><LI><A HREF='/a>b'>One</A><LI>Two</UL>
        <H2 title=don't>High water</H2><P>{PROSE}<P>{MORE}<script>if (a<b) {{ x("</p>") }}</script>
        <style>p:before {{content: "<p>"}}</style></BODY>""",
    "article with header, aside and footer": f"""<body><article><header><h1>High water</h1></header>
        <p>{PROSE}</p><aside><p>{"A box of facts about rivers. " * 9}</p></aside><p>{MORE}</p>
        <footer>Tags: river, town</footer></article><div class=other><p>{"Read on. " * 30}</p></div></body>""",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert M.extract(LAYOUTS[name], WORDS, TAGS) == f"High water {PROSE} {MORE}"


PAGES = [
    ("<article>a&amp;b &lt;i&gt; &eacute;&#x41;&#66;&nbsp;c &ampd &am</article>", "a&b <i> éAB c &d &am"),
    ("<article><p>one<b>two</b> <i>three</i>\n\t four<br>five<p> six </article>", "onetwo three four five six"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<article><pre>a\n  b</pre>1 < 2 and 3>2<!-- no --><![CDATA[x]]></article>", "a b 1 < 2 and 3>2"),
    ("<article><h1>x</h1><figure><img><figcaption>y</figcaption></figure><hr><hr><p>z</p>", "x y z"),
    ("<nav><a>Home</a></nav><script>var a = 'text';</script>", ""),
    ("", ""),
    (f"<nav>{PROSE}</nav><article>Short.</article><footer>{PROSE}</footer><p>{PROSE}", "Short."),
    ("no markup at all", "no markup at all"),
    ("<p>cut <a href='x", "cut"),
    ("<article><p>a</p><!-- cut", "a"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert M.extract(page, WORDS, TAGS) == text


def test_scan_equals_all_parts():
    draw = random.Random(1)
    for _ in range(300):
        values = [draw.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(draw.randrange(12))]
        parts = [
            (sum(values[i:j]), -i, j)
            for i in range(len(values))
            for j in range(i + 1, len(values) + 1)
        ]
        start, end = M.best(values)
        top = max([p[0] for p in parts], default=0.0)
        assert sum(values[start:end]) == max(top, 0.0)


def test_long_and_deep_pages():
    page = "<article>" + f"<p>{PROSE}</p>" * 20000 + "</article>"
    assert M.extract(page, WORDS, TAGS) == " ".join([PROSE] * 20000)
    assert M.extract("<div>" * 30000 + "<p>" + PROSE, WORDS, TAGS) == PROSE
    assert M.extract("<article>" + "<a '\"= " * 20000 + ">" + PROSE, WORDS, TAGS) == PROSE


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, None, page), (1, None, page), (None, "u", None), (2, "u", "")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, n_chars int")
    got = sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in M.main_texts(frame).collect())
    whole = ("1", "None", PROSE, len(PROSE))
    assert got == sorted([whole, whole, ("None", "u", "", 0), ("2", "u", "", 0)])
    empty = M.main_texts(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]
