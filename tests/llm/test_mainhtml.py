"""Main text against pages whose article is known."""

import random
import time

import pytest

from labelmill.llm import mainhtml
from labelmill.llm.mainhtml import main_text

WORDS = "amber brook cedar delta ember fjord grove haven islet jetty knoll ledge marsh north olive pearl quarry river stone thorn".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/x">Other page</a><li><a href="/y">Third</a></ul>'
AROUND = [
    '<nav><a href="/a">First link</a> <a href="/b">Second</a></nav>',
    '<header class="site-header"><a href="/">Site name</a><p>The slogan of the site</p></header>',
    '<header><h1>Name of the paper</h1></header>',
    '<aside><h3>Beside</h3><p>Words that stand beside the article and are of some length, so that they look like it.</p></aside>',
    '<div class="sidebar"><p>More words beside the article, also of some length, and without any link in them.</p></div>',
    '<div id="cookie-banner" role="dialog"><p>We use cookies. Accept them, please, or don\'t.</p><button>Accept</button></div>',
    '<div class="ad">Buy one of these very good things today, and get another one for nothing.</div>',
    '<ins class="adsbygoogle">Advert text</ins>',
    '<form action="/s"><label>Search this site</label><input name="q"><select><option>one<option>two</select><textarea>typed</textarea></form>',
    '<footer><p>&copy; 2020 Somebody. All rights reserved, in all the countries of the world.</p></footer>',
    '<script>var x = "<p>not text</p>"; if (a < b) { document.write("<article>no</article>") }</script>',
    "<style>p > b { color: red }</style><!-- <p>a comment > with marks</p> -->",
    '<noscript><p>Switch scripts on.</p></noscript><template><p>Template text</p></template>',
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>A reader says that all of this is quite wrong, at length.</p></article><p>Another reader agrees with that.</p></section>',
    '<div class="comment-list"><p>First! And a long remark of a reader about what the article says.</p></div>',
    '<div class="newsletter-signup"><p>Get our letter every week, with the best of what we write.</p></div>',
    MENU,
]


def article(rng):
    """(html, blocks) of an article with the usual parts."""
    title, blocks, html = prose(rng, 5), [], []
    html.append(f"<h1>{title}</h1>")
    blocks.append(title)
    for k in range(rng.randint(2, 7)):
        kind = rng.randrange(6)
        a, b = prose(rng, rng.randint(25, 60)), prose(rng, rng.randint(8, 30))
        if kind == 0:
            html.append(f"<p>{a} <b>{b}</b>\n  {a}</p>")
            blocks.append(f"{a} {b} {a}")
        elif kind == 1:
            html.append(f"<p>{a}<br>\n{b}<p>{b} &amp; <i>more</i>")
            blocks += [f"{a} {b}", f"{b} & more"]
        elif kind == 2:
            html.append(f"<ul><li>{a}<li><p>{b}</p></ul>")
            blocks += [a, b]
        elif kind == 3:
            html.append(f'<blockquote>{a} <a href="/z">{b[:9]}</a></blockquote>')
            blocks.append(f"{a} {b[:9]}")
        elif kind == 4:
            html.append(f"<table><tr><td>{a}<td>{b}<tr><td>{b}</table>")
            blocks += [a, b, b]
        else:
            html.append(f'<div><p>{a}</p><div class="ad">Buy this.</div><p>{b}&nbsp;&#x41;&eacute;</p></div>')
            blocks += [a, f"{b} Aé"]
    return "".join(html), blocks


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><article class='post no-comments'>%s</article></main>", "<main>%s</main>", '<div id="content"><div class="post-body">%s</div></div>'])
def test_article_among_what_surrounds_it(seed, wrap):
    rng = random.Random(seed)
    html, blocks = article(rng)
    around = rng.sample(AROUND, rng.randint(0, len(AROUND)))
    cut = rng.randint(0, len(around))
    page = "<!DOCTYPE html><html><head><title>T &lt;</title></head><body class='has-sidebar'>" + "".join(around[:cut]) + wrap % html + "".join(around[cut:])
    assert main_text(page + "</body></html>").split("\n") == blocks
    assert main_text(page).split("\n") == blocks


def test_article_without_any_mark_by_density():
    rng = random.Random(5)
    links = "".join(f'<div><a href="/{k}">{prose(rng, 4)}</a> | <a href="/{k}x">{prose(rng, 3)}</a></div>' for k in range(30))
    paragraphs = [prose(rng, 60) for _ in range(6)]
    page = f"<body><div><div>{links}</div></div><div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></div><div>{links}</div></body>"
    assert main_text(page).split("\n") == paragraphs


def test_header_of_the_article_stays_and_that_of_the_page_goes():
    page = "<body><header><h1>Paper</h1></header><article><header><h1>Title</h1><p>By somebody</p></header><p>Text of it.</p><footer>Filed under x</footer></article></body>"
    assert main_text(page) == "Title\nBy somebody\nText of it."


def test_inline_marks_make_no_space_and_blocks_do():
    assert main_text("<article>a<b>b</b><script>x</script>c<p>d<div>e</div>f</article>") == "abc\nd\ne\nf"
    assert main_text("<article><p>a<!-- x -->b</p>\n\t c   d</article>") == "ab\nc d"


def test_references_and_odd_marks():
    assert main_text("<article>1 < 2 &amp;lt; &notit; &#65; &#x110000; &am</article>") == "1 < 2 &lt; ¬it; A � &am"
    assert main_text("<article>x <3 y </ z></article>") == "x <3 y"
    assert main_text('<article title="a>b"><p class=x/y>c</p></article>') == "c"
    assert main_text("<article>text <b") == "text"
    assert main_text("<article>text <!-- open <p>gone</p>") == "text"
    assert main_text("<article>text<script>never closed <p>gone</p>") == "text"


def test_pages_without_an_article():
    assert [main_text(x) for x in (None, "", "  \n", "<html></html>", "<nav>only a menu</nav>", "<form><p>Log in</p></form>", "<div hidden>x</div>")] == [""] * 7
    assert main_text("just words") == "just words"
    assert main_text("<p>one</p>") == "one"


def test_form_around_the_whole_page():
    assert main_text('<form id="f"><nav>menu</nav><article><p>Text.</p><form>inner</form></article></form>') == "Text."


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<b>" * 60_000 + "x" + "</i>" * 60_000, "<p><b>" * 30_000 + "x", "<ul><li>" * 20_000 + "<li>x" * 20_000, "<a " * 60_000, '<a x="' * 60_000, "<!--" * 60_000, "<" * 200_000, "<table><tr><td>" * 20_000 + "x", "</p>" * 60_000 + "x", "<li><ul><div>" * 9000 + "<li></li>" * 9000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10


def test_random_bytes_give_some_text():
    rng = random.Random(9)
    parts = ["<", ">", "/", "p", "div", "article", "a", " ", '"', "=", "x", "&", "amp", ";", "!--", "--", "table", "td", "li", "head", "body", "script", "svg", "\n"]
    for _ in range(2000):
        got = main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 60))))
        assert all(x == " ".join(x.split()) and x for x in got.split("\n")) or got == ""


def test_rows(spark):
    rows = [(1, "u", "<article>a</article>", "t"), (1, None, "<p>b", "t"), (2, "v", None, None), (None, "w", "", "t"), (3, "x", "<article>" + "<p>word word</p>" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in mainhtml.extract(pages).collect()), key=str)
    want = [(1, "u", "a", 1), (1, None, "b", 1), (2, "v", "", 0), (0, "w", "", 0), (3, "x", "\n".join(["word word"] * 50_000), 50_000 * 10 - 1)]
    assert got == sorted(want, key=str)
    assert mainhtml.extract(pages.limit(0)).collect() == []
