import random
import time

import pytest

from logradex.llm import html

from .test_llm import CHROME, TAIL, frame, page

GONE = [
    "<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", "<div class='share-bar'>{}</div>",
    "<div id='comments'>{}</div>", "<div hidden>{}</div>", "<div role='navigation'>{}</div>", "<div class='ad'>{}</div>",
    "<div class='related-posts'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div style='display: none'>{}</div>",
]
INLINE_GONE = [
    "<script>var x = '<p>{}</p>'</script>", "<style>{}</style>", "<!-- {} -->", "<button>{}</button>", "<span hidden>{}</span>",
    "<svg><text>{}</text></svg>", "<select><option>{}</select>", "<video>{}</video>", "<textarea>{}</textarea>", "<template>{}</template>",
]
KEPT = [
    "<div>{}</div>", "<section class='discussion'>{}</section>", "<div id='related-work'>{}</div>", "<div class='entry-header'>{}</div>",
    "<blockquote>{}</blockquote>", "<figure>{}</figure>", "<details>{}</details>", "<my-part>{}</my-part>", "<header>{}</header>",
]
LEAF = ["<p>{}</p>", "<p class='teaser'>{}</p>", "<h2>{}</h2>", "<p>{}", "<ul><li>{}</ul>", "<pre>{}</pre>", "<table><tr><td>{}</table>"]


def tree(rng, depth, blocks, number, kept=True):
    """Markup at random, with the blocks that it is made of put into ``blocks``."""
    out = []
    for _ in range(rng.randint(1, 4)):
        roll = rng.random()
        if depth and roll < 0.35:
            out.append(rng.choice(KEPT).format(tree(rng, depth - 1, blocks, number, kept)))
        elif depth and roll < 0.6:
            out.append(rng.choice(GONE).format(tree(rng, depth - 1, blocks, number, False)))
        else:
            words = []
            for _ in range(rng.randint(1, 5)):
                number[0] += 1
                words.append(f"w{number[0]}&amp;")
            inner = rng.choice([" ", "\n\t ", "<br>", " <b>x</b> ", " <i>x</i>\n"]).join(words)
            text = inner.replace("<br>", " ")
            for mark in ("<b>", "</b>", "<i>", "</i>"):
                text = text.replace(mark, "")
            if rng.random() < 0.3:
                inner += rng.choice(INLINE_GONE).format("gone")
            if kept:
                blocks.append(" ".join(text.replace("&amp;", "&").split()))
            out.append(rng.choice(LEAF).format(inner))
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_every_block_of_an_article_occurs_once_in_order(seed):
    rng = random.Random(seed)
    blocks = []
    for wrap in ("<article>{}</article>", "<main>{}</main>"):
        blocks.clear()
        source = page(CHROME + wrap.format(tree(rng, 4, blocks, [0]) + "<p>end") + TAIL)
        blocks.append("end")
        assert html.main_text(source, []) == "\n\n".join(blocks)
        path = html.parse(source).nodes[max(html.best(html.parse(source)), default=0)].path
        assert html.main_text(source, [path]) == "\n\n".join(blocks)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><svg/><p>a</p><video><p>b</p><select><p>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>a <span class='ad'>x <span>y</span></span> b</p></article>", "a b"),
        ("<div class=content><div class=intro>a quarter</div><div class=body>three quarters of all of this</div></div>",
         "a quarter\n\nthree quarters of all of this"),
        ("<main><h1>T</h1><article class=a>one</article><article class=b>two</article></main>", "T\n\none\n\ntwo"),
        ("<article class=a>one</article><article class=b>two</article>", "one\n\ntwo"),
        ("<ul><li><a>Home</a><li><a>Two Words</a></ul><div><p>Text here</p><ul><li><a>ref</a><li>x</ul></div>", "Text here\n\nref\n\nx"),
        ("<article><header><h1>T</h1><p>lead</p></header><p>x<hr>y</p></article>", "T\n\nlead\n\nx\n\ny"),
        ("<article>a<xmp>&lt;b></xmp></article>", "a\n\n&lt;b>"),
        ("<form><div><p>all in a form</p></div></form>", "all in a form"),
    ],
)
def test_nothing_else_is_lost(body, text):
    assert html.main_text(page(body), []) == text


def test_nesting_and_stray_tags_are_linear():
    begin = time.perf_counter()
    n = 8000
    for source in (
        "<div>" * n + "x</p></b>" * n + "</div>" * n, "</p>" * 3 * n, "<span hidden>" * n + "<hr>" * n, "<video>" * n + "x",
        "<table><tr><td>" * n, "<li>" * n, "<a>" * n + "<ul><li>" * n,
    ):
        html.main_text(source, [])
    assert time.perf_counter() - begin < 5


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    rows = [(1, "http://a/", long, "h", 1), (1, "http://a/", long, "h", 1), (None, "http://a/x", "", None, None), (2, "x", "<p>y", "h", 2)]
    df = frame(spark, rows, "page_id long, url string, html string, host string, paths int")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.n_chars) for r in out.collect())
    assert got == [(0, 0), (1, 20000 * 6 - 2), (1, 20000 * 6 - 2), (2, 1)]


def test_ties_between_paths(spark):
    one, two = page("<div class='a'><p>one</p></div>"), page("<div class='b'><p>two</p></div>")
    rows = [(i, "http://a/", s) for i, s in enumerate([one, two, one, two, None])]
    got = {r.page_id: r.text for r in html.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "one", 1: "two", 2: "one", 3: "two", 4: ""}
