import re
from html import unescape

import pytest

from cartulary.llm.pages import LABELLED, blocks, decide, extract_pages, grow, main_text, trained

import numpy as np

TREE = trained()


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<article></article>", ""),
    ("<body><nav><a href='/'>Home</a></nav><article><h1>A  title</h1><p>One<br>two &amp; three.</p></article><footer>&copy; x</footer>", "A title One two & three."),
    ("<article><p>a<b>b</b>c</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>last</article>", "abc last"),
    ("<div class=\"ad\">Buy this now.</div><main><p>Body text.</p><div class='share-links'><a>x</a></div></main>", "Body text."),
    ("<article><p>Text.</p><section id=comments><article class='comment'><p>I think so too.</p></article></section></article>", "Text."),
    ("<article><header><h1>Head</h1></header><p>Text.</p><form><p>Your mail:</p><input></form><aside>More</aside></article>", "Head Text."),
    ("<article><p>1 &lt; 2 &#x263A;&nbsp;end</p></article>", "1 < 2 ☺ end"),
    ("<article><p title='a > b'>x</p><p>y", "x y"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article><p>a</p><script>never closed <p>b</p>", "a"), ("<header><p>Site</p></header><article><p>In</p></article>", "In"),
])
def test_cases(html, text):
    assert main_text(html, TREE) == text


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><meta charset=x><body><article><p>In.</p></article>", "In."),
    ("<head><title>t</title><article><p>In.</p></article>", "In."), ("<head><article>In.</article>", "In."),
    ("<svg viewBox='0 0 1 1'/><article><p>In.</p></article>", "In."), ("<article><p>a<svg><text>x</text></svg>b</p></article>", "ab"),
    ("<svg><text>x<article><p>In.</p></article>", "In."), ("<article><p>a</p><svg><text>x</text><p>b</p></article>", "a b"),
    ("<object data='x'><article><p>In.</p><p>On.</p></article>", "In. On."), ("<article><p>a <object data=x>b</p><p>c</p></article>", "a b c"),
    ("<article><p>a</p><object data=x><p>Not shown.</p></object><p>b</p></article>", "a b"),
    ("<article><p>a</p><canvas id=c><p>b</p></article>", "a b"), ("<canvas/><article>In.</article>", "In."),
    ("<button>Menu<article><p>In.</p></article>", "In."), ("<article><p>a</p><button><div>Save</div></button><p>b</p></article>", "a b"),
    ("<div><button>Menu</div><article><p>In.</p></article>", "In."),
    ("<article><p>a</p><select><option>x<option>y<p>b</p></article>", "a b"),
    ("<template><article><p>No.</p></article></template><article><p>In.</p></article>", "In."),
    ("<article><p>a</p><svg><foreignObject><div>x</div></foreignObject><text>y</text></svg><p>b</p></article>", "a b"),
])
def test_elements_set_apart_end_where_they_must(html, text):
    assert main_text(html, TREE) == text


def test_pages_without_an_article_element():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul>"
    long = [" ".join(f"word{i}" for i in range(n)) for n in (40, 60, 30)]
    html = f"<body>{menu}{''.join(f'<p>{p}</p>' for p in long)}<div class=footer>All rights</div></body>"
    assert main_text(html, TREE) == " ".join(long)


def test_tree_agrees_with_its_table():
    table = np.array(LABELLED, dtype=float)
    assert (decide(TREE, table[:, :-1]) == table[:, -1]).mean() > 0.9
    exact = grow(table[:, :-1], table[:, -1], depth=50, least=1)
    assert (decide(exact, table[:, :-1]) == table[:, -1]).all()


def test_blocks_carry_words_and_links():
    found = blocks("<p>one two <a>three</a></p><ul><li><a>x y</a></ul>")
    assert [(b.text, b.words, b.linked) for b in found] == [("one two three", 3, 1), ("x y", 2, 2)]


def test_all_given_pages(spark, small):
    """The article of each given page, by a rule that holds for their one template."""
    rows = extract_pages(spark.read.parquet(f"{small}/pages.parquet")).collect()
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<b>", "").replace("</b>", "")
        assert r["main_text"] == " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    assert len(rows) > 10


def test_very_long_and_empty(spark):
    long = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", long), (3, "u", long), (4, "u", "a < b and <unclosed")]
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(len(r["main_text"]) for r in found)[-2:] == [16 * 50_000 - 1] * 2 and len(found) == 5
    assert extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def grid(place, apart, n=20_000):
    draw = np.random.default_rng(7)
    words, links = (lambda: draw.integers(1, 90, n)), (lambda: draw.choice([0.0, 0.1, 0.9, 1.0], n))
    return np.column_stack([words(), links(), words(), links(), words(), links(), np.full(n, place), np.full(n, apart)]).astype(float)


def test_the_article_element_decides_where_there_is_one():
    for apart, place, text in ((0, 1, True), (1, 1, False), (0, -1, False), (1, -1, False), (1, 0, False)):
        assert (decide(TREE, grid(place, apart)) == text).all()


def test_neighbours_decide_on_pages_without_one():
    """Short blocks are text beside text, and none between lists of links; changing the neighbours changes them."""
    rows = grid(0, 0)
    rows[:, 0], rows[:, 1] = rows[:, 0] % 8 + 1, 0.0
    beside, between, one = (rows.copy() for _ in range(3))
    beside[:, [3, 5]], between[:, [3, 5]] = 0.0, 1.0
    one[:, 3], one[:, 5] = 1.0, 0.0
    assert decide(TREE, beside).all() and decide(TREE, one).all() and not decide(TREE, between).any()
    rows = grid(0, 0)
    other = rows.copy()
    other[:, [3, 5]] = 1 - other[:, [3, 5]]
    assert (decide(TREE, rows) != decide(TREE, other)).any()


SHORT = ["It rained all day.", "Then it stopped.", "One.", "About the river"]
LONG_ONES = [" ".join(f"{w}{i}" for i in range(n)) for w, n in (("a", 40), ("b", 25), ("c", 12))]


@pytest.mark.parametrize("seed", range(30))
def test_labelled_pages_without_an_article_element(seed):
    """Pages drawn with known labels: a menu, a title, paragraphs of any length, a list of links, a footer."""
    draw = np.random.default_rng(seed)
    link = lambda i: f"<li><a href='/{i}'>Item number {i}</a></li>"
    menu = "<ul>" + "".join(map(link, range(draw.integers(2, 6)))) + "</ul>"
    text = ["About our town", *draw.choice(SHORT + LONG_ONES, draw.integers(2, 7)).tolist()]
    body = "".join(f"<{t}>{p}</{t}>" for t, p in zip(["h1", *["p"] * len(text)], text))
    more = f"<ul>{link(7)}<li>More</li>{link(8)}</ul>" if draw.random() < 0.5 else ""
    html = f"<body>{menu}{body}{more}{menu}<div class='footer'><p>All rights reserved.</p></div></body>"
    assert main_text(html, TREE) == " ".join(text)


@pytest.mark.parametrize("junk", ["<p title='", "<a b=\"'", "<a '>", "<!-", "<p title='>\"", "<script ", "<a b='c\" >", "<title>", "<![CDATA[", "<"])
def test_markup_that_never_ends_takes_linear_time(junk):
    import time

    page = junk * (5_000_000 // len(junk))
    begun = time.perf_counter()
    main_text(page, TREE)
    assert time.perf_counter() - begun < 10  # 0.1 to 1.5 s; a scan that starts again at every tag takes hours


def test_a_quote_without_an_end_is_an_ordinary_character():
    assert main_text("<article><p title='x>In.</p><p>On.</p></article>", TREE) == "In. On."
    assert main_text("<article><p title=it's>In.</p><p title='a > b'>On.</p></article>", TREE).endswith("On.")
