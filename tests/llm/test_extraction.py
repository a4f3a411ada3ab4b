"""Main text by minimum cut, with the costs learned from the fixtures and with the prior ones."""

import itertools
import random

import pytest

from coverlake.llm import extraction

PROSE = " ".join(
    ["Readers who follow the river upstream find the old mill, long since closed, and beside it the house where the miller lived."] * 3
)
BODY = "<p>A long paragraph of the article, with many words in it, that ends with a stop as such texts do.</p>"
TEXT = "A long paragraph of the article, with many words in it, that ends with a stop as such texts do."
MORE = f"<p>{PROSE} So it goes on.</p>"


@pytest.fixture(scope="module", params=["prior", "sf0.001", "sf0.01"])
def costs(request, spark):
    if request.param == "prior":
        return dict(extraction.PRIOR)
    return extraction.fit(spark.read.parquet(f"/root/testdata/{request.param}/pages.parquet").select("page_id", "url", "html"))


@pytest.mark.parametrize(
    "name",
    ["comments", "comment-list", "advert", "ad", "ad-slot sponsored", "sidebar", "related", "newsletter", "cookie-notice", "social share"]
)
def test_named_prose_goes(costs, name):
    parts = [
        f'<div class="{name}"><p>{PROSE}</p></div>', f'<section id="{name}"><p>{PROSE}</p><p>{PROSE}</p></section>',
        f'<div class="{name}"><ul><li><p>{PROSE}</p></li><li><p>{PROSE}</p></li></ul></div>',
        f'<div class="{name}"><div><div><p>{PROSE}</p></div></div></div>', f'<div class="{name}"><p>Buy now.</p></div>'
    ]
    for part in parts:
        for page in (
            f"<article>{BODY}{MORE}</article>{part}", f"{part}<main>{BODY}{MORE}</main>", f"<article>{BODY}{part}{MORE}</article>",
            f"<article>{BODY}{MORE}{part}</article>", f"<body><div class=post>{BODY}{MORE}</div>{part}</body>",
            f"<body>{BODY}{part}{MORE}</body>"
        ):
            assert extraction.main_text(page, costs) == f"{TEXT} {PROSE} So it goes on.", page


def test_paragraphs_of_an_article(costs):
    lead = "Readers who follow the river upstream find the old mill, long since closed."
    assert extraction.main_text(f'<article><p class="lead related">{lead}</p>{BODY}</article>', costs) == f"{lead} {TEXT}"
    for name in ("advert", "ad", "sponsored", "newsletter-signup", "comment"):
        assert extraction.main_text(
            f'<article>{BODY}<p class="{name}">{PROSE}</p>{MORE}</article>', costs
        ) == f"{TEXT} {PROSE} So it goes on.", name


def test_linked_lists_of_an_article_stay(costs):
    links = "".join(f'<li><a href="/s{k}">Source {k} of what is told here</a></li>' for k in range(5))
    want = " ".join([TEXT, "Sources", *[f"Source {k} of what is told here" for k in range(5)]])
    assert extraction.main_text(f"<article>{BODY}<h2>Sources</h2><ul>{links}</ul></article>", costs) == want
    assert extraction.main_text(f"<nav><ul>{links}</ul></nav><article>{BODY}</article><ul>{links}</ul>", costs) == TEXT


def test_unnamed_prose_beside_an_article_goes(costs):
    whole = f"{TEXT} {PROSE} So it goes on. {TEXT}"
    for part in (f"<div><p>{PROSE}</p></div>", "<div><p>Buy now and save.</p></div>", f"<p>{PROSE}</p>"):
        assert extraction.main_text(f"<body><article>{BODY}{MORE}{BODY}</article>{part}</body>", costs) == whole
    # an article of a few words is a teaser, not the page's text
    assert extraction.main_text(
        f"<body><article><h2>Short</h2></article><div>{BODY}{MORE}</div></body>", costs
    ).endswith(f"{TEXT} {PROSE} So it goes on.")


def test_names_of_whole_pages(costs):
    for name in ("sidebar-right", "header-fixed", "site nav-left", "with-widget search"):
        assert extraction.main_text(
            f'<body><div class="{name}"><div>{BODY}{MORE}</div></div></body>', costs
        ) == f"{TEXT} {PROSE} So it goes on.", name
    for name in ("comments", "advert", "newsletter"):  # such names are not layouts
        assert extraction.main_text(f'<body><div class="{name}">{MORE}</div></body>', costs) == ""


def plain(html, costs):
    """The labelling of least cost, by trying all; of equal ones that with least content."""
    blocks = extraction.read(html)
    inside = sum(len(b[0].split(" ")) for b in blocks if b[6] and b[1] > 0)
    gain = []
    for b in blocks:
        shape = sum(costs.get(f, 0.0) for f in extraction.shape(b))
        gain.append(b[1] + max(-4.0, min(4.0, shape)) - (6.0 if inside > 40 and not b[6] and not b[1] else 0.0))
    pairs = [(i - 1, i, 0.8) for i in range(1, len(blocks))]
    for i, b in enumerate(blocks):
        beside = [j for j in range(i) if blocks[j][3] == b[3]]
        pairs += [(beside[-1], i, 0.4)] if beside else []

    def cost(labels):
        return sum(
            max(-g, 0) if keep else max(g, 0) for g, keep in zip(gain, labels)
        ) + sum(w for i, j, w in pairs if labels[i] != labels[j])

    best = min(itertools.product([False, True], repeat=len(blocks)), key=lambda x: (round(cost(x), 9), sum(x)))
    return " ".join(b[0] for b, keep in zip(blocks, best) if keep)


def test_against_all_labellings(costs):
    rng = random.Random(9)
    words = "the river mill of stone and old water under many bridges that".split()

    def block(depth):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 20, 60]))) + rng.choice([".", "", "!"])
        if kind < 0.2:
            text = f"<a href=x>{text}</a>"
        if depth and kind > 0.75:
            name = rng.choice(["", "", ' class="sidebar"', ' class="ad"', ' id="story"'])
            tag = rng.choice(["div", "section", "article", "ul", "aside"])
            return f"<{tag}{name}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"
        tag = rng.choice(["p", "p", "p", "h2", "li", "div"])
        return f"<{tag}{rng.choice(['', '', '', ' class=notice'])}>{text}</{tag}>"

    tried = 0
    for _ in range(300):
        html = "".join(block(2) for _ in range(rng.randint(1, 5)))
        if 1 < len(extraction.read(html)) <= 11:
            assert extraction.main_text(html, costs) == plain(html, costs), html
            tried += 1
    assert tried > 100
