"""Pages that list articles: the tree, selectors, and extractors of three shapes."""

import datetime
import json

import pytest

from coverlake.sources import listpages, pagedata
from coverlake.sources.listpages import Selector, Tree, items

HTML = """<div id=top class="a b"><p>one<p class="x y">two <b>bold</b><br>three</div><ul><li data-k="ab-c"><a href="/1" title='T1'>L1</a><li><a href='http://o.org/2'>L2</a></ul><img src=x>"""


@pytest.mark.parametrize("selector,want", [
    ("p", ["one two bold three", "two bold three"]), (".b p.x", ["two bold three"]), ("#top > p", ["one two bold three"]), ("li[data-k]", ["L1 L2"]), ("[data-k=ab-c] a", ["L1", "L2"]), ("[data-k^='ab'][data-k$=c] > a", ["L1"]),
    ("li[data-k*='b-'], b", ["bold", "L1 L2"]), ("*[class~=y]", ["two bold three"]), ("ul a[href^=http]", ["L2"]), ("ul > li > li", ["L2"]), ("table", []), ("div div", []),
])
def test_selectors(selector, want):
    assert [n.text() for n in Selector(selector).all(Tree(HTML).root)] == want


@pytest.mark.parametrize("selector", ["", "a >", "[x", "a,,b", "a..b"])
def test_bad_selectors(selector):
    with pytest.raises(ValueError):
        Selector(selector)


BLOCKS = {"name": "cards", "host": "e.org", "shape": "blocks", "item": "li", "link": "a@href", "title": "a", "date": "@data-k"}
LINKS = {"name": "dated", "host": "*", "shape": "links", "pattern": r"^/(?P<date>20\d\d-\d\d-\d\d)/"}
SCRIPT = {
    "name": "state", "host": "s.org", "shape": "script", "begins": r"STATE\s*=", "items": "a.0.list", "link": "id", "title": "t.plain",
    "date": "when", "prefix": "/x/"
}


def test_extractors():
    assert items(HTML, "https://www.e.org/f/", [BLOCKS, LINKS]) == [
        ("cards", "https://www.e.org/1", "L1", "ab-c"), ("cards", "http://o.org/2", "L2", "")
    ]
    page = '<a href="/2024-01-05/a">A</a><a href="/2024-01-05/a">again</a><a href="/x">x</a><a href="/2024-02-05/b" title="B"></a>'
    assert items(page, "https://f.org/", [BLOCKS, LINKS]) == [
        ("dated", "https://f.org/2024-01-05/a", "A", "2024-01-05"), ("dated", "https://f.org/2024-02-05/b", "B", "2024-02-05")
    ]
    state = json.dumps({"a": [{"list": [{"id": 7, "t": {"plain": "q < </b>  r"}, "when": "2024-01-01"}, {"t": None}, "no"]}]})
    assert items(f"<script>no</script><script>STATE = {state}; more()</script>", "https://a.s.org/y", [SCRIPT]) == [
        ("state", "https://a.s.org/x/7", "q < </b> r", "2024-01-01"), ("state", "https://a.s.org/x/", "", "")
    ]
    assert items(
        "<script>STATE = {broken</script>", "https://s.org", [SCRIPT]
    ) == [] and items(None, None, [BLOCKS, LINKS]) == [] and items("<li>", "https://[bad", [BLOCKS]) == []
    data = {
        "@graph": [
            {"@type": "WebPage"},
            {
                "@type": "CollectionPage",
                "mainEntity": {
                    "@type": ["X", "ItemList"],
                    "itemListElement": [
                        {"item": {"url": "/u", "headline": "H", "dateModified": "2024"}}, {"url": "/u"}, {"name": "no link"}, 3
                    ]
                }
            }
        ]
    }
    assert items(
        f'<script type="application/ld+json">{{</script><script type="application/ld+json">{json.dumps(data)}</script>{HTML}',
        "https://e.org", [BLOCKS]
    ) == [("data", "https://e.org/u", "H", "2024"), ("data", "", "no link", "")]
    deep = "<div>" * 20_000 + "<a href=/2024-01-01/z>z</a>"
    assert items(deep, "https://e.org/", [LINKS]) == [("dated", "https://e.org/2024-01-01/z", "z", "2024-01-01")]


def test_list_items(spark):
    pages = spark.createDataFrame(
        [
            (1, HTML, "https://e.org/"), (2, None, None), (3, '<a href="/2024-01-05/some-title">  </a>', "https://f.org/"),
            (4, "<p>none", "https://e.org/")
        ],
        "id long, html string, url string"
    )
    rows = listpages.list_items(pages, [BLOCKS, LINKS], limit=1).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "https://e.org/", "cards", 1, "https://e.org/1", "L1", None),
        (3, "https://f.org/", "dated", 1, "https://f.org/2024-01-05/some-title", "Some title", datetime.datetime(2024, 1, 5, 12))
    ]
    with pytest.raises(ValueError):
        listpages.list_items(pages, [{**BLOCKS, "item": "["}])


def test_signals(spark):
    graph = {
        "@graph": [
            {"@type": "NewsArticle", "articleSection": "Sport", "keywords": ["k1", " "]},
            {"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": "In"}}, {"item": "https://x"}]}
        ]
    }
    nested = [[{"@type": "X", "articleSection": ["A", "B"], "breadcrumb": {"itemListElement": [{"name": "C"}]}}], {"keywords": "p, q;r"}]
    html = f"""<meta content="M &amp; N" property="og:section"><META NAME='news_keywords' CONTENT='w'><script type='application/ld+json'>{{bad</script><script type="application/ld+json">{json.dumps(graph)}</script><script type="application/ld+json">{json.dumps(nested).replace('"', '&quot;')}</script>"""
    rows = pagedata.signals(
        spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    ).orderBy("page_id", "rank", "place").collect()
    assert [(r["kind"], r["signal"]) for r in rows] == [
        ("meta", "M & N"), ("article_section", "Sport"), ("article_section", "A"), ("article_section", "B"), ("breadcrumb", "Home"),
        ("breadcrumb", "In"), ("breadcrumb", "https://x"), ("breadcrumb", "C"), ("keywords", "w"), ("keywords", "k1"), ("keywords", "p"),
        ("keywords", "q"), ("keywords", "r")
    ]
    assert {r["page_id"] for r in rows} == {1}


def test_broken_scripts_fail_once(spark):
    """Only a script with something to unescape is tried again."""
    script = '<script type="application/ld+json">{}</script>'.format
    rows = spark.createDataFrame([("a", script("{broken")), ("b", script("{&quot;k&quot;: 1}")), ("c", script('{"k": "&amp;"}'))], "page_id string, html string")
    found = pagedata.objects(rows)
    assert sorted((r[0], r[1]) for r in found.selectExpr("page_id", "to_json(object)").collect()) == [("b", '{"k":1}'), ("c", '{"k":"&amp;"}')]
    assert "contains(" in found._jdf.queryExecution().optimizedPlan().toString().lower()
