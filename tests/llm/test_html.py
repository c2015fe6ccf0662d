import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgrain.llm import html_extract
from loomgrain.llm.html_extract import content_lines, extract_main_text, main_text, smooth

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More links</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now, it is cheap and good and you want it.</div>
<article><h1>Big &amp; small</h1><p><b>First  paragraph
with a line.<br><p>Second one, long enough to be content of this page.</p><ul><li>item one</li><li>item two</li></ul><p>No.</p></article>
<aside>Sidebar text that is long enough to look like content of the page.</aside>
<form><p>Subscribe here</p><input></form><section id="comments"><p>I like this page very much, said a reader.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == "Big & small\n\nFirst paragraph with a line.\n\nSecond one, long enough to be content of this page.\n\nitem one\n\nitem two\n\nNo."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain <b>bold</b>", "plain bold"), ("<p>only", "only"),
        ("<div><p>One two.<p>Three four.</div><form>f</form>", "One two.\n\nThree four."),
        ("<article>a &lt;b&gt; &#233;&nbsp;c</article>", "a <b> é c"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a hr", "cut"), ("<article>x<!-- y -->z</article>", "xz"), ("<p>x<!-- y <p>z</p>", "x"), ("<p>x <a href='y <b z", "x"),
        ("<nav>menu</nav>", ""), ("<p>a</div></p><p>b</p>", "a\n\nb"), ("< 3 and 4 > 2", "< 3 and 4 > 2"),
        ("<html><head><title>T</title><body><p>text</p>", "text"), ("<head><title>T</title>\n<p>text</p>", "text"), ("<head><meta name=a> text", "text"), ("<head><a href=x>text</a> too", "text too"),
        ("<head><noscript><p>n</p></noscript><style>s</style><title>T</title></head><body>text", "text"), ("<head><template><p>n</p></template><body><p>text", "text"), ("<head><noscript><p>n<body><p>text", "text"),
    ],
)
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_page_without_article():
    page = "<body><div id=menu><a href=x>one</a><a href=y>two</a></div><div><h2>Title</h2>" + "<p>Words of a text that goes on for long.</p>" * 5 + "<p>Ok.</p></div><div class=footer>end</div></body>"
    assert main_text(page).split("\n\n") == ["Title", *["Words of a text that goes on for long."] * 5, "Ok."]


LONG, LAST = "<p>" + "Words of a text that goes on for long. " * 30 + "</p>", "The last paragraph is content as well, though it is short. " * 3


@pytest.mark.parametrize("page", [
    "<body><div><div>{long}</div><div><p>{last}</p></div></div></body>", "<body><div>{long}</div><p>{last}</p></body>", "<p>{last}</p><article>{long}</article>",
    "<main><p>{last}</p><article>{long}</article></main>", "<article>{long}</article><article><p>{last}</article>", "<main>{long}</main><section><p>{last}</section>",
])
def test_no_content_line_is_lost(page):
    blocks = main_text(page.format(long=LONG * 2, last=LAST)).split("\n\n")
    assert LAST.strip() in blocks and len(blocks) == 3


def test_short_article_and_lines_around():
    menu = "<div><ul>" + "<li><a href=x>Entry</a></li>" * 4 + "</ul></div>"
    page = f"<body>{menu}<h1>Title</h1><article>{LONG}</article><article><p>Short.</p></article><div><a href=y>{'More of this site ' * 30}</a></div></body>"
    assert main_text(page).split("\n\n") == ["Title", main_text(LONG), "Short."]
    page = f"<body>{menu}<div>{LONG}<p>Ok.</p></div><div><a href=y>{'More of this site ' * 30}</a></div></body>"
    assert main_text(page).split("\n\n") == [main_text(LONG), "Ok."]
    assert main_text(f"<body><article><p>Card.</article><div>{LONG}</div></body>").split("\n\n") == ["Card.", main_text(LONG)]


@pytest.mark.parametrize("page", [
    '<article>{a}<section id="discussion"><h2>D</h2>{b}</section></article>', '<article>{a}<h2 id="related-work">D</h2>{b}</article>', '<article>{a}<h2 id="search">D</h2>{b}</article>',
    '<div class="content has-sidebar">{a}<h2>D</h2>{b}</div>', '<div class="form-page">{a}<h2>D</h2>{b}</div>', '<div class="sidebar-right">{a}<h2>D</h2>{b}</div><footer>end</footer>',
    "<form><input>{a}<h2>D</h2>{b}<select><option>o</select></form>", '<form><article>{a}<h2>D</h2>{b}</article><div class="sidebar">{b}{a}</div></form>',
    '<div class="form-page"><div>{a}<h2>D</h2>{b}</div><div id="comments">{a}{a}{a}</div></div>', '<article>{a}<section id="search"><h2>D</h2><p>{b}</section></article>',
])
def test_marked_words_alone_drop_nothing(page):
    assert main_text(page.format(a=LONG, b=f"<p>{LAST}</p>")).split("\n\n") == [main_text(LONG), "D", LAST.strip()]


@pytest.mark.parametrize("extra", [
    '<div class="ad">{b}</div>', '<div id="comments"><article class="comment">{a}{a}{a}</article></div>', '<div class="related-posts"><ul><li><a href=x>{b}</a></ul></div>', '<div class="sidebar">{b}</div>',
    '<div class="page-sidebar">{b}</div>', '<div id="search"><form>{b}<input></form></div>', '<div class="social share"><a href=x>one</a><a href=y>two</a></div>', '<div class="notice">{c}</div>', "<form>{b}</form>", '<p><span class="ad">Buy now</span></p>',
])
def test_marked_boilerplate_goes(extra):
    page = "<body><div>{a}{a}{a}{a}</div>" + extra + "</body>"
    assert main_text(page.format(a=LONG, b=f"<p>{LAST}</p>", c="<p>This site is moving, and some of its links fail until then.</p>")).split("\n\n") == [main_text(LONG)] * 4
    assert main_text("<form>Name <input><button>Go</button></form>") == ""


def test_very_long_page():
    blocks = [f"Paragraph {k} has some words in it." for k in range(20_000)]
    assert main_text("<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") == "\n\n".join(blocks)


@pytest.mark.parametrize("make", [
    lambda n: "<div>x" * n, lambda n: "<i>" * n + "<p>a</p>" * n, lambda n: "<b><article>" + "<i>" * n + "x</b>" * n, lambda n: '<div class="ad">word ' * n + "</div>" * n,
    lambda n: "<div><p>Some words of a text that are content here, ten of them.</p>" * n, lambda n: "<!--" * n, lambda n: "<a href='" * n, lambda n: "<ul><li>" * n, lambda n: "<head><template>" * n,
])
def test_time_is_in_proportion(make):
    """Nested, unclosed and marked elements: four times as many take about four times as long."""

    def seconds(n):
        start = time.perf_counter()
        main_text(make(n))
        return time.perf_counter() - start

    assert min(seconds(32_000) for _ in range(2)) < 10 * max(seconds(8_000), 0.03)


def prose(rng, n):
    return " ".join(rng.choices("the a river stone house walks over under green old slowly bread wind and of to".split(), k=n)).capitalize() + "."


def made_page(seed):
    """A page without article or main, and the text that a reader would call its article. Layouts, tags and sizes vary."""
    rng = random.Random(seed)
    title, blocks, html = prose(rng, 4), [], []
    for _ in range(rng.randint(4, 9)):
        kind = rng.random()
        if kind < 0.7:
            text = prose(rng, rng.randint(25, 90))
            blocks.append(text)
            html.append(f"<p>{text.replace('river', '<em>river</em>')}</p>")
        elif kind < 0.85:
            items = [prose(rng, rng.randint(12, 20)) for _ in range(3)]
            blocks += items
            html.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
        else:
            blocks.append(quote := prose(rng, 30))
            html.append(f"<blockquote>{quote}</blockquote>")
    body = "".join(html)
    menu = "".join(f"<li><a href=/{k}>{prose(rng, 2)}</a></li>" for k in range(rng.randint(4, 12)))
    short = "".join(f"<tr><td>{prose(rng, 1)}<td><b>{k}</b>" for k in range(rng.randint(3, 8)))
    top, low = f"<div><ul>{menu}</ul></div>", f"<div><table>{short}</table></div>"
    wrap = [f"<div><h1>{title}</h1>{body}</div>", f"<div><div><h1>{title}</h1></div><section>{body}</section></div>", f"<table><tr><td><h1>{title}</h1>{body}</table>", f"<center><h1>{title}</h1>{body}</center>"][seed % 4]
    page = [f"<body>{top}{wrap}{low}</body>", f"<body>{low}{top}{wrap}</body>", f"<body>{wrap}{top}{low}</body>"][seed % 3]
    return page, "\n\n".join([title, *blocks])


@pytest.mark.parametrize("seed", range(24))
def test_pages_without_article(seed, monkeypatch):
    """No tag or class tells the article, so the clustering of lines decides: switched off, menus and tables come along."""
    page, want = made_page(seed)
    assert main_text(page) == want
    monkeypatch.setattr(html_extract, "content_lines", lambda lines, sigma=1.0: [True] * len(lines))
    assert main_text(page) != want


def test_smoothing_keeps_constants():
    assert smooth([3.0] * 9) == pytest.approx([3.0] * 9)
    assert content_lines([]) == []


def test_whole_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x", 7), (1, "u", PAGE, "x", 7), (2, None, None, "y", 8)], "page_id long, url string, html string, text string, n_chars int")
    rows = extract_main_text(pages).orderBy("page_id").collect()
    assert [r.page_id for r in rows] == [1, 1, 2] and rows[0].text == main_text(PAGE) and rows[2].text == "" and rows[2].n_chars == 0
    assert rows[0].n_chars == len(rows[0].text)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_fixture_articles(spark):
    """The fixture's pages have one article each; its blocks are known from its own marks."""
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").where(F.col("html").isNotNull()).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = body if "</article>" in r.html else re.sub(r"<[^>]*$", "", body)
        blocks = [" ".join(entities.unescape(re.sub(r"<(br|b|/b)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


BROKEN = ["<![>", "<![ endif]>", "<![foo[x]]>", "<![1]>", "<![endif]-->", "<!>", "<!->", "<!x y>", "<!DOCTYPE [<!ENTITY a>", "<?php echo 1 ?>", "</>", "</ p>", "<a b'c>", "&#" + "9" * 6000 + ";", "&#x" + "f" * 6000 + ";", "<![CDATA[x]]>", "<p/ =a>"]


@pytest.mark.parametrize("piece", BROKEN)
def test_no_markup_fails_or_hides_the_text_after_it(piece):
    assert main_text(f"<article><p>Before the piece.</p>{piece}<p>After the piece.</p></article>").split("\n\n")[-1] == "After the piece."
    main_text(piece)
    main_text(piece[:-1])


@pytest.mark.parametrize("piece", [
    '<script>document.write("<!--")</script>', "<style><!-- p {} </style>", "<textarea><!--</textarea>", "<!-- a --!>", "<!-->", "<!--->", '<p title="<!--x">Titled.</p>', "<title><!--</title>", "<!-- a -- b -->",
    "<script>if (a<b) x='</p><!--'</script >", "<textarea>not closed", "<iframe><!--</iframe>", "<title>never closed",
])
def test_what_only_looks_like_a_comment_hides_nothing(piece):
    text = main_text(f"<body>{piece}<article><p>The text of this page.</p></article>")
    if piece.endswith("closed"):
        piece = ""  # elements without end take what they hold
    else:
        assert text.split("\n\n")[-1] == "The text of this page."
    assert main_text(f"{piece}<p>The text of this page.</p>").endswith("The text of this page.")


def boiler(k, words=14):
    """Ten words and more, hardly a link, and nearly a tag a word."""
    return "<div><div>" + " ".join(f"<b>w{k}{i}</b>" if i % 2 else f"<i>w{k}{i}</i>" for i in range(words)) + "</div></div>"


VERSE = [f"The {a} moon goes {b} again" for a in ("pale", "old", "cold", "thin") for b in ("down", "home", "dark")]
TALK = [f"“{a}?” — “Not {b}, no.”" for a in ("You went there alone", "Who saw the boat", "Was it raining") for b in ("today", "really", "me")]
CAPTIONS = [f"Plate {k}: the harbour at noon" for k in range(1, 10)]


@pytest.mark.parametrize("lines", [VERSE, TALK, CAPTIONS])
@pytest.mark.parametrize("tag", ["p", "li", "div"])
def test_only_the_ratio_tells(lines, tag, monkeypatch):
    """Short lines of an article between long boilerplate without names, links or article tags: the clustering decides."""
    body = "".join(f"<{tag}>{x}</{tag}>" for x in lines)
    page = f"<body><div>{''.join(map(boiler, range(4)))}</div><div>{body}</div><div>{''.join(map(boiler, range(4, 8)))}</div></body>"
    assert main_text(page).split("\n\n") == lines
    for decision in (False, True):
        monkeypatch.setattr(html_extract, "content_lines", lambda x, sigma=1.0, d=decision: [d] * len(x))
        assert main_text(page).split("\n\n") != lines


@pytest.mark.parametrize("seed", range(24))
def test_without_content_lines_pages_change(seed, monkeypatch):
    page, want = made_page(seed)
    monkeypatch.setattr(html_extract, "content_lines", lambda lines, sigma=1.0: [False] * len(lines))
    assert main_text(page) != want


def test_broken_rows_survive(spark):
    rows = [(k, f"<article><p>Text {k}.</p>{x}<p>End {k}.</p>") for k, x in enumerate(BROKEN)]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id").collect()
    assert len(found) == len(BROKEN) and all(r.text.endswith(f"End {r.page_id}.") for r in found)
