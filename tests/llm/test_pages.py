import time
from html.parser import HTMLParser

import cases
import pytest

from tillstone.llm import pages, skew
from tillstone.llm.pages import Page

SITE = """<!doctype html><html><head><title>t &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="page home"><header><h2>Site</h2></header><nav><ul><li><a href=/>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post-{n} entry"><h1>Title {n}</h1><p>First&nbsp;paragraph of {n} with <b>bold</b>   text &lt;ok&gt;<br>
and a line.<p>Second paragraph, unclosed <i>markup<ul><li>one<li>two</ul><form><input><label>Name</label></form>
<div class="ad-slot">Buy</div><!-- <p>comment</p> --><blockquote>Quoted.</blockquote></div>
<aside>Aside</aside><section id="comments"><p>A reader says this and that and more</p></section></div>
<div><p>unmarked rest of the site, the same everywhere</p></div>
<footer>&copy; site</footer></body></html>"""
TEXT = "Title {n}\nFirst paragraph of {n} with bold text <ok>\nand a line.\nSecond paragraph, unclosed markup\none\ntwo\nQuoted."


def extracted(spark, rows, tables):
    table = spark.createDataFrame([(*row, "x", "y") for row in rows], "page_id bigint, url string, html string, host string, blocks string")
    return {(row["page_id"], row["url"]): row for row in pages.extracted(table, tables).collect()}


def test_pages_of_a_host(spark, tables):
    rows = [(n, f"http://a.net/{n}", SITE.replace("{n}", str(n))) for n in range(12)]
    found = extracted(spark, rows, tables)
    for n in range(12):
        row = found[n, f"http://a.net/{n}"]
        assert row["text"] == TEXT.replace("{n}", str(n))
        assert row["n_chars"] == len(row["text"])


def test_a_page_follows_its_host(spark, tables):
    listing = '<body><div class="main-col"><p>short</p></div><div class="links-col"><p>' + "much more text here " * 20 + "</p></div></body>"
    normal = '<body><div class="main-col"><p>' + "the story goes on " * 30 + '</p></div><div class="links-col"><p>few</p></div></body>'
    rows = [(n, f"http://b.net/{n}", normal) for n in range(9)] + [(9, "http://b.net/9", listing)]
    found = extracted(spark, rows, tables)
    assert found[9, "http://b.net/9"]["text"] == "short"
    assert found[0, "http://b.net/0"]["text"] == ("the story goes on " * 30).strip()


def test_odd_pages(spark, tables):
    long = "<article>" + "".join(f"<p>{cases.prose(n, 40)}</p>" for n in range(800)) + "</article>"
    rows = [
        (1, "http://c.net/", None),
        (2, None, ""),
        (3, "no scheme", "plain text only"),
        (None, "http://d.net/", "<article><p>x"),
        (4, "http://e.net/", long),
        (5, "http://f.net/", "<script>never closed <p>x</p>"),
        (6, "http://g.net/", "<!-- never closed <p>x</p>"),
        (7, "http://h.net/", "</p></div>a < b &amp; c &#233;&unknown; <b>d</i> e"),
        (7, "http://h.net/2", "<article><p>one</p></article>"),
    ]
    found = extracted(spark, rows, tables)
    texts = {key: row["text"] for key, row in found.items()}
    assert texts[1, "http://c.net/"] == texts[2, None] == texts[5, "http://f.net/"] == texts[6, "http://g.net/"] == ""
    assert texts[3, "no scheme"] == "plain text only"
    assert texts[None, "http://d.net/"] == "x"
    assert texts[4, "http://e.net/"] == "\n".join(cases.prose(n, 40) for n in range(800))
    assert texts[7, "http://h.net/"] == "a < b & c é&unknown; d e"


def test_empty_table(spark, tables):
    assert extracted(spark, [], tables) == {}


def test_paths_are_generalised():
    page = Page('<body><div class="b12 a"><p>x</p></div></body>')
    assert page.blocks == ["x"] and page.steps == ["body", "div.a.b"] and page.spans == [[0, 1], [0, 1]]
    other = Page('<div><i>y</i><div class="a b7">z</div></div>')
    assert other.steps[2] == page.steps[1] and other.paths[2] != page.paths[1]
    assert Page('<p>first</p><div class="a b4">z</div>').paths[1] == page.paths[1]


def test_layout_words_do_not_drop_the_article(spark, tables):
    story, rows = "the story goes on " * 30, []
    wrappers = ['div class="content no-sidebar"', 'div id="page" class="has-sidebar header-fixed"', 'section class="share-story"',
                'div id="search-result"', 'div data-id="menu" class="text" data-class="ad"']
    for n, wrapper in enumerate(wrappers):
        end = wrapper.split()[0]
        noise = '<div class="comments">me too</div><p class="social">like it</p>'
        rows.append((n, f"http://w{n}.net/", f"<html><body><{wrapper}><h1>T</h1><p>{story}</p>{noise}</{end}><div class=sidebar>ad</div></body>"))
    found = extracted(spark, rows, tables)
    assert [found[n, f"http://w{n}.net/"]["text"] for n in range(len(rows))] == [f"T\n{story.strip()}"] * len(rows)


def test_long_comments_stay_out(spark, tables):
    story, comment = "the story goes on " * 30, "a reader says so " * 40
    source = f'<body><div class="post"><p>{story}</p></div><div id="comments"><p>{comment}</p></div></body>'
    assert extracted(spark, [(1, "http://a.net/", source)], tables)[1, "http://a.net/"]["text"] == story.strip()


def test_suspect_parts_do_not_leave_a_page_empty():
    page = Page(f'<div class="share-story">{"story " * 40}</div><div class="comments">{"me " * 60}</div><div class="related">{"see " * 40}</div>')
    assert page.blocks == [("story " * 40).strip()]


def test_text_outside_containers_is_kept(spark, tables):
    body = "<h1>T</h1><p>the article</p><p>goes on</p>"
    box = body + '<div class="box">see also</div>'
    sources = [body, box, f"<html><body class=home>{box}</body></html>", f"<div><p>x</p></div>{body * 9}"]
    found = extracted(spark, [(n, f"http://r{n}.net/", source) for n, source in enumerate(sources)], tables)
    texts = [found[n, f"http://r{n}.net/"]["text"] for n in range(len(sources))]
    article = "T\nthe article\ngoes on"
    assert texts == [article, article + "\nsee also", article + "\nsee also", "\n".join(["x", *[article] * 9])]


class Article(HTMLParser):
    """A plain reading of an article: blocks of its text, by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.blocks, self.parts = 0, 0, [], []
        self.feed(source)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in ("script", "style", "nav", "aside", "form", "footer")
        if tag in pages.BREAKS:
            self.cut()

    def handle_endtag(self, tag):
        if tag in pages.BREAKS:
            self.cut()
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style", "nav", "aside", "form", "footer")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


def test_whole_table_equals_a_plain_reading(spark, tables):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {row["page_id"]: row["text"] for row in pages.extracted(table, tables).collect()}
    wanted = {row["page_id"]: "\n".join(Article(row["html"] or "").blocks) for row in table.collect()}
    assert found == wanted


BROKEN = {
    "nested containers": "<div>" * 30_000 + "text",
    "unclosed inline elements": "<b><i>x " * 20_000 + "<p>y</p>" * 3000,
    "end tags of nothing": "</b>" * 200_000,
    "nested suspects": "<div class=ad>" * 30_000 + "x" * 100 + "</div>" * 30_000,
    "tags without an end": "<a " * 200_000,
    "quotes without an end": '<a b="' * 100_000 + ">",
    "open comments": "<!-" * 200_000 + "<!--" * 100_000,
    "one megabyte of open elements": "<div><b><p>word " * 60_000,
}


@pytest.mark.parametrize("name", list(BROKEN))
def test_broken_pages_take_time_in_proportion(name):
    """A page four times as long takes about four times as long; quadratic work would take sixteen times."""
    whole, times = BROKEN[name], []
    for source in (whole[: len(whole) // 4], whole):
        best = min(timed(source) for _ in range(2))
        times.append(max(best, 0.02))
    assert times[1] < 9 * times[0] and times[1] < 10


def timed(source):
    start = time.process_time()
    pages.scores(Page(source))
    return time.process_time() - start


def test_formulas_and_the_articles_own_header_stay(spark, tables):
    story = "the story goes on " * 30
    inner = f"<header><h1>T</h1></header><p>{story}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>"
    rows = [(n, f"http://m{n}.net/", f"<body><header>site</header><{tag}>{inner}</{tag}></body>") for n, tag in enumerate(["article", "main"])]
    found = extracted(spark, rows, tables)
    for n in range(2):
        assert found[n, f"http://m{n}.net/"]["text"] == f"T\n{story.strip()}\nso x=1 holds"


def test_hot_hosts_are_not_joined_in_one_task(spark, tables, monkeypatch):
    rows = [(n, f"http://hot.net/{n}" if n % 3 else f"http://h{n}.net/", SITE.replace("{n}", str(n))) for n in range(60)]
    rows += [(100, None, SITE.replace("{n}", "100")), (101, "http://empty.net/", None)]
    monkeypatch.setattr(skew.with_totals, "__defaults__", (10,))
    found = extracted(spark, rows, tables)
    assert all(found[n, url]["text"] == (TEXT.replace("{n}", str(n)) if html else "") for n, url, html in rows)
