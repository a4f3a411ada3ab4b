"""Sitemap indexes: what their names and dates tell, rules of hosts, and the frontier."""

import datetime

from pyspark.sql import functions as F

from coverlake.functions.exprs import at
from coverlake.operators import stages
from coverlake.sources import sitemaps

def now():
    return at("2024-01-20 12:00:00")


def index(*children):
    return "<sitemapindex>" + "".join(
        f"<sitemap><loc>{loc}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</sitemap>" for loc, d in children
    ) + "</sitemapindex>"


def test_dates_and_numbers(spark):
    cases = [
        ("https://e.org/2024/1/5/x.xml", datetime.date(2024, 1, 5), 5), ("https://e.org/s-2023-12.xml", datetime.date(2023, 12, 1), 12), ("https://e.org/s.xml?yyyy=2022&mm=3&dd=9", datetime.date(2022, 3, 9), 9),
        ("https://e.org/s.xml?from=400", None, -400), ("https://e.org/s.xml", None, None), ("https://e.org/2024/13/x", None, 13), ("https://e.org/2023/02/31/a", datetime.date(2023, 3, 3), 31), ("https://e.org/sitemap_77.xml.gz", None, 77),
    ]
    rows = spark.createDataFrame([(c[0],) for c in cases], "loc string").select(
        "loc", sitemaps.address_date(F.col("loc")).alias("d"), sitemaps.number_at_end(F.col("loc")).alias("n")
    ).collect()
    assert [tuple(r) for r in rows] == cases


def test_names_of_files_count_and_hosts_do_not(spark):
    body = index(
        ("https://news.example.org/tag-sitemap.xml", None), ("https://news.example.org/plain.xml", None), ("/news-sitemap.xml", None),
        ("post-sitemap2.xml", "2024-01-19T00:00:00Z"), ("https://news.example.org/archive.xml", "2023-01-01"),
        ("https://news.example.org/gnews.xml.gz", "2023-01-01")
    )
    docs = spark.createDataFrame([(1, "https://news.example.org/maps/index.xml", body)], "id long, url string, body string")
    rows = sitemaps.children(docs, now(), of=["id"]).orderBy("rank").collect()
    assert [(r["loc"], r["score"]) for r in rows] == [
        ("https://news.example.org/news-sitemap.xml", 600), ("https://news.example.org/gnews.xml.gz", 480),
        ("https://news.example.org/maps/post-sitemap2.xml", 400)
    ]
    assert [r["rank"] for r in sitemaps.children(docs, now(), of=["id"], limit=2).collect()] == [1, 2]


def test_all_children_where_none_scores(spark):
    body = "<x:sitemapindex xmlns:x='y'><x:sitemap><x:loc>https://e.org/a1.xml</x:loc><x:sitemap><x:loc>https://e.org/a2.xml</x:loc><x:sitemap><x:loc></x:loc></x:sitemapindex>"
    docs = spark.createDataFrame(
        [(1, None, body), (2, "u", "<urlset><sitemap><loc>https://e.org/no</loc></sitemap></urlset>"), (3, "u", None)],
        "id long, url string, body string"
    )
    assert [
        (r["id"], r["loc"], r["rank"]) for r in sitemaps.children(docs, now(), of=["id"]).orderBy("rank").collect()
    ] == [(1, "https://e.org/a2.xml", 1), (1, "https://e.org/a1.xml", 2)]


def test_rules_of_hosts(spark):
    body = index(*[(f"https://e.org/articles_2024_0{m}.xml", None) for m in (1, 3, 2)], ("https://e.org/news-sitemap.xml", "2024-01-20"))
    docs = spark.createDataFrame(
        [(1, "https://www.e.org/i.xml", body), (2, "https://f.org/i.xml", body)], "id long, url string, body string"
    )
    hosts = spark.createDataFrame([("e.org", r"/articles_20\d{2}_\d{2}\.xml$", 2)], "host string, pattern string, most int")
    rows = sitemaps.children(docs, now(), of=["id"], hosts=hosts).orderBy("id", "rank").collect()
    assert [(r["id"], r["loc"].rsplit("/")[-1]) for r in rows] == [
        (1, "articles_2024_03.xml"), (1, "articles_2024_02.xml"), (2, "news-sitemap.xml")
    ]


def test_frontier(spark):
    def name(k):
        return f"https://e.org/posts/i{k}.xml"

    docs = [
        (name(k), index((name(k + 1), None), (name(k - 1), None), (name(0), None), (f"https://e.org/posts/leaf{k}.xml", None)))
        for k in range(7)
    ]
    docs += [(f"https://e.org/posts/leaf{k}.xml", "<rss></rss>" if k % 2 else "<urlset></urlset>") for k in range(7)]
    roots = spark.createDataFrame(
        [("a", name(0)), ("a", name(0)), ("b", name(5)), ("c", "https://e.org/posts/leaf3.xml"), ("d", "https://e.org/none")],
        "root string, url string"
    )
    documents = spark.createDataFrame(docs, "url string, body string")
    plans = []
    with stages.scope():
        out = sitemaps.expanded(roots, documents, now(), depth=3)
        plans = [
            sitemaps.expanded(roots, documents, now(), depth=d)._jdf.queryExecution().executedPlan().toString().count("ExistingRDD")
            for d in (2, 6)
        ]
        got = sorted((r["root"], int(r["url"][-5]), r["depth"]) for r in out.collect())
    assert plans == [0, 0]  # results come from stored rounds, not from the documents again
    # b walks down from 5 and up to 6, and to 0 from each
    assert got == sorted(
        [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 2), ("b", 1, 3), ("b", 3, 3), ("b", 4, 2), ("b", 5, 1), ("b", 6, 2), ("c", 3, 0)]
    )


def test_scopes_of_threads(spark, tmp_path):
    import os
    import threading
    import urllib.parse

    places = {}

    def job(k):
        with stages.scope():
            for _ in range(3):
                df = stages.stored(spark.range(10 + k))
                places.setdefault(k, []).append(urllib.parse.urlparse(df.inputFiles()[0]).path)
                assert df.count() == 10 + k

    threads = [threading.Thread(target=job, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(len(p) == 3 for p in places.values()) and not any(os.path.exists(x) for p in places.values() for x in p)
    with stages.scope():
        with stages.kept() as own:
            stages.stored(spark.range(3))
            stages.delete([own.pop()])
            after = stages.stored(spark.range(4))
        assert after.count() == 4 and len(own) == 1
    assert not os.path.exists(urllib.parse.urlparse(own[0]).path)
