import itertools
import random

import pytest

from sensorloom.llm import html_text
from sensorloom.session import ship_package

LONG = "A sentence of the article which is long enough to look like content, with a comma."
PAGES = {
    "marked": (
        f'<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy it now, it is cheap and very good.</div>'
        f"<article><h1>Head</h1><p>{LONG}<p>Short<ul><li>One</li><li>Two</li></ul><aside>{LONG}</aside><footer>By me</footer></article><footer>&copy; Site</footer></body></html>",
        f"Head\n{LONG}\nShort\nOne\nTwo",
    ),
    "unmarked": (
        f'<div id="main-menu"><a href="/a">News of the day</a><a href="/b">Sport of the day</a></div><div class="cookie-banner"><p>{LONG}</p></div>'
        f'<div><h2>Head of it</h2><p>{LONG}</p><p>{LONG} More.</p></div><div id="comments"><article><p>{LONG}</p></article></div><form><p>{LONG}</p><input></form>',
        f"Head of it\n{LONG}\n{LONG} More.",
    ),
    "references and space": (f"<main><p>&lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;x \n\t y<br>z &bogus; 1 < 2.</p><pre>a\n b {LONG}</pre></main>", f"<b> &amp; éé x y z &bogus; 1 < 2.\na b {LONG}"),
    "cut short": (f"<article><p>{LONG}</p><p>{LONG} &amp; end<scr", f"{LONG}\n{LONG} & end"),
    "script swallows": (f"<article><p>{LONG}</p><script>var a='<p>no</p>'", LONG),
    "comment": (f"<article><!-- <p>no</p> --><p>{LONG}</p><!-- open", LONG),
    "in header": (f"<article><header><h1>Title of it</h1></header><p>{LONG}</p></article><header><p>Site slogan, which is a sentence.</p></header>", f"Title of it\n{LONG}"),
    "names that say otherwise": (f'<div class="site no-sidebar"><article class="post category-social-science tag-legal"><h1>Head</h1><p>{LONG}</p></article></div>', f"Head\n{LONG}"),
    "names of layout": (f'<article><p>{LONG}</p></article><div class="site-footer"><p>{LONG}</p></div><div id="main_nav-list"><p>{LONG}</p></div>', LONG),
    "icons": (f'<article><p><svg class="i"/>{LONG}</p><p><svg><path d="M0 0"/></svg>{LONG}</p><object data="x"/><p>{LONG}</p></article>', f"{LONG}\n{LONG}\n{LONG}"),
    "media": (f'<article><p>{LONG}</p><video controls><source src="a"></video><audio src="b"></audio><canvas></canvas><p>{LONG}</p></article>', f"{LONG}\n{LONG}"),
    "empty": ("", ""),
    "markup only": ("<div><p></p></div>", ""),
    "links only": ('<ul><li><a href="/">One link here</a></li><li><a href="/">Two links here</a></li></ul>', ""),
    "bad nesting": (f"</p></div><article><b><p>{LONG}</b></article></article><p", LONG),
    "quotes": (f'<article><p title="a > b">{LONG}</p><p title="open>{LONG}</p></article>', f"{LONG}\n{LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, text = PAGES[name]
    assert html_text.main_text(html) == text


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(a, b, rng.uniform(0, 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]

        def cost(label):
            return sum(abs(s) for s, x in zip(scores, label) if (s > 0) != x) + sum(w for a, b, w in ties if label[a] != label[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_text.minimum_cut(scores, ties)) == pytest.approx(best)


def test_rows_stay(spark):
    ship_package(spark)
    rows = [(1, "u", PAGES["marked"][0], 7), (1, "u", PAGES["marked"][0], 7), (None, None, None, None), (2, None, "<p>" + LONG * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert [(r[0], r[1], r[3]) for r in found if r[0] != 1] == [(2, None, len(LONG) * 5000), (None, None, 0)]
    assert sum(r == (1, "u", PAGES["marked"][1], len(PAGES["marked"][1])) for r in found) == 2
    assert html_text.extract_text(pages.limit(0)).count() == 0
