from __future__ import annotations

import pytest

from cladeflow.llm.html_text import PLAIN, best_stretch, html_text, learn_weights, main_text, read_page, scored

PROSE = "Some words of the article that go on for a while, as articles do. " * 4


def brute_stretch(scores):
    sums = [(sum(scores[i:j]), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    return max([0, *(s for s, _ in sums)])


@pytest.mark.parametrize("scores", [[], [-1], [1, -2, 3], [2, -1, 2, -5, 3], [-1, 4, -1, -1, 4, -9, 6], [0, 0]])
def test_best_stretch_has_the_greatest_sum(scores):
    i, j = best_stretch(scores)
    assert sum(scores[i:j]) == brute_stretch(scores)


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
    <nav><a href="/">Home</a> <a>More</a></nav><header>Site</header>
    <article><h1>Big &amp; small</h1><p>{PROSE}</p><script>var x = "<p>no</p>";</script>
    <p>caf&eacute;   au
    lait<br>now</p><div class="advert">Buy</div><ul><li>one</li><li>two</li></ul></article>
    <aside>Side</aside><div id="comments"><p>Nice!</p></div><footer>Foot</footer></body></html>"""
    assert main_text(page, PLAIN).split("\n\n") == ["Big & small", PROSE.strip(), "café au lait now", "one", "two"]


def test_page_without_article_element():
    page = f"<body><div class=menu><a>x</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div class='footer'>f</div></body>"
    assert main_text(page, PLAIN) == f"{PROSE.strip()}\n\n{PROSE.strip()}"


def brute_text(page, weights):
    """Text of the best of all stretches, for pages without an article element."""
    tokens, _ = read_page(page)
    scores = scored(tokens, weights)
    _, i, j = max(((round(sum(scores[i:j]), 9), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    blocks = {}
    for t in tokens[-i : -j]:
        if t[0] == "text" and not t[3]:
            blocks.setdefault(t[2], []).append(t[1])
    return "\n\n".join(b for b in (" ".join("".join(x).split()) for x in blocks.values()) if b)


def test_names_that_labelled_pages_have_outside_of_articles_weigh_less(spark):
    """Pages without an article element against all stretches, with weights learned from others."""
    rail = "Read what others wrote about it in these last few days and weeks. " * 2
    labelled = f"<body><div class='rail-x'><p>{rail}</p></div><article><div class='copy'><p>{PROSE}</p></div></article></body>"
    bare = f"<body><div class='rail-x'><p>{rail}</p></div><section><h2>Title</h2><p>{PROSE}</p><p>Short end.</p></section><div class='rail-x'>{rail}</div></body>"
    rows = [(i, "u", labelled) for i in range(12)] + [(100, "u", bare)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = learn_weights(pages)
    assert weights[".rail-x"] < 0.1 and weights[".copy"] > 0.9
    got = {r["page_id"]: r["text"] for r in html_text(pages).collect()}
    assert got[0] == PROSE.strip()
    assert got[100] == f"Title\n\n{PROSE.strip()}\n\nShort end." == brute_text(bare, weights)


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!-- no end", "&amp", "<nav>only menu</nav>", "<script>x", "</p></p>"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(main_text(page, PLAIN), str)


def test_all_rows_come_back(spark):
    page = f"<body><nav>m</nav><article><p>{PROSE}</p></article></body>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", None), (3, "w", "<p>" * 5000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text(pages).collect()), key=repr)
    text = PROSE.strip()
    want = [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)]
    assert got == sorted(want, key=repr)
    assert html_text(pages.limit(0)).count() == 0
