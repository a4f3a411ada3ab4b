"""Feed, sitemap, page and catalog readers on small documents."""

import datetime
import json

from coverlake.sources import feeds

RSS = """<rss><channel><item><title><![CDATA[One &amp; only]]></title><link>https://e.org/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><guid>g1</guid><category>A</category><category>B</category><description>d</description></item>
<item><title></title><link>//e.org/2024/01/05/x</link></item><item><title>three</title></item></channel></rss>"""
ATOM = """<feed><entry><title>A</title><link rel="alternate" href="https://e.org/a"/><updated>2024-01-03T00:00:00Z</updated><id>i</id></entry></feed>"""
MAP = """<urlset><url><loc>https://e.org/old</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://news.e.org/new-story</loc><news:news><news:publication_date>2024-02-01</news:publication_date></news:news></url><url><loc>https://other.com/x</loc></url><url><loc>https://e.org/undated</loc></url></urlset>"""
BROKEN = "<urlset><url><loc>https://e.org/a</loc><url><loc>https://e.org/b</loc>"


def test_feeds(spark):
    rows = feeds.feed_items(
        spark.createDataFrame([(1, RSS), (2, ATOM), (3, ""), (4, None)], "doc_id long, body string"), 2
    ).orderBy("doc_id", "at").collect()
    assert [(r["doc_id"], r["title"], r["link"]) for r in rows] == [
        (1, "One & only", "https://e.org/1"), (1, "", "https://e.org/2024/01/05/x"), (2, "A", "https://e.org/a")
    ]
    assert rows[0]["categories"] == ["A", "B"] and rows[0]["feed_id"] == "g1"
    assert rows[0]["missing"] == [] and rows[1]["missing"] == ["title", "description"] and rows[1]["published_at"] == datetime.datetime(2024, 1, 5)
    assert rows[2]["published_at"] == datetime.datetime(2024, 1, 3)


def test_sitemaps(spark):
    df = spark.createDataFrame([(1, MAP, "https://www.e.org"), (2, BROKEN, "https://e.org")], "doc_id long, body string, base_url string")
    rows = feeds.sitemap_entries(df).orderBy("doc_id", "rank").collect()
    assert [(r["doc_id"], r["link"]) for r in rows] == [
        (1, "https://news.e.org/new-story"), (1, "https://e.org/old"), (1, "https://e.org/undated"), (2, "https://e.org/a"),
        (2, "https://e.org/b")
    ]
    assert rows[0]["title"] == "New story"


def test_pages(spark):
    ld = json.dumps(
        {
            "articleSection": "Sport", "datePublished": "2024-01-01",
            "itemListElement": [
                {"position": 1, "url": "u1", "name": "n1"}, {"position": 2, "item": {"url": "u2", "name": "n2"}},
                {"position": 3, "url": "u1", "name": "again"}
            ]
        }
    )
    html = f'<head><meta property="article:tag" content="x"><meta property="article:tag" content="y"><script type="application/ld+json">{ld}</script></head>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    first = feeds.page_signals(df).orderBy("page_id").first()
    assert (first["section"], first["categories"], first["date"]) == ("Sport", ["x", "y"], "2024-01-01")
    assert [(r["link"], r["title"]) for r in feeds.collection_items(df).orderBy("rank").collect()] == [("u1", "n1"), ("u2", "n2")]


def test_catalog(spark, tmp_path):
    f = tmp_path / "catalog.json"
    f.write_text(
        json.dumps(
            {
                "countries": [
                    {
                        "name": "A", "code": "AA",
                        "feeds": [
                            {"name": "s", "url": None, "sitemapUrl": "m", "distributionClass": "portal"},
                            {"name": "s", "url": "u", "sitemapUrl": "m2", "distributionClass": "publisher"}
                        ]
                    }
                ]
            }
        )
    )
    row = feeds.read_catalog(spark, str(f)).first()
    assert (row["country"], row["source"], row["url"], row["sitemap"], row["distribution_class"]) == ("A", "s", "u", "m", "publisher")


def test_charsets():
    import gzip

    from coverlake.sources.charset import to_text

    word = "Größe é"
    assert to_text(word.encode(), None) == word
    assert to_text(gzip.compress(word.encode("latin-1")), "text/html; charset=ISO-8859-1") == word
    assert to_text(b'<?xml version="1.0" encoding="windows-1252"?>' + word.encode("cp1252"), "").endswith(word)
    assert to_text(b"\xff\xfe" + word.encode("utf-16-le"), None) == word
    assert to_text(word.encode("cp1252"), "charset=nonsense") == word
    assert to_text(None, None) == "" and to_text(b"\x1f\x8bbroken", None) == ""


def test_read_documents(spark, tmp_path):
    import gzip

    from coverlake.sources.charset import read_documents

    (tmp_path / "a.xml").write_bytes(RSS.encode())
    (tmp_path / "b.xml").write_bytes(gzip.compress(ATOM.encode()))
    items = feeds.feed_items(read_documents(spark, str(tmp_path)))
    assert sorted(r["title"] for r in items.collect()) == ["", "A", "One & only", "three"]
