"""Landed documents over the fixtures: feeds, sitemaps and pages written from known rows, then read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..functions import text
from ..functions.exprs import at
from ..sources import feeds, sitemaps as maps
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF
from . import repair, taxonomy


def escaped(c: Column | str) -> Column:
    """As XML text; null is empty."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def element(name: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


def joined(rows: DataFrame, body: Column) -> DataFrame:
    """One document (doc_id, inside) per source of its rows in order of their number; a source's documents are small."""
    each = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("event_id", body.alias("b")))).alias("_all"))
    return each.select(F.col("source").alias("doc_id"), F.array_join(F.transform("_all", lambda r: r["b"]), "\n").alias("inside"))


def rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of all articles: every third has no date, every fifth an Atom-like prefix on its item."""
    date = F.when(
        F.col("event_id") % 3 != 0, element("pubDate", F.date_format("publication_datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ).otherwise("")
    inner = F.concat(
        element("title", F.concat(F.lit("<![CDATA["), F.coalesce("title_original", F.lit("")), F.lit("]]>"))),
        element("link", escaped("url")), date, element("guid", escaped("stable_id")),
        F.array_join(F.transform("feed_categories", lambda c: element("category", c)), "")
    )
    item = F.when(
        F.col("event_id") % 5 == 0, F.concat(F.lit("<rss:item about='x'>"), inner, F.lit("</rss:item>"))
    ).otherwise(element("item", inner))
    return joined(fx.articles(spark, sf_dir), item).select("doc_id", element("rss", element("channel", F.col("inside"))).alias("body"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed_items(rss(spark, sf_dir), 10)
    return rows.select(
        "doc_id", F.col("at").cast("long").alias("at"), "title", "link", "feed_id",
        F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.array_join("categories", "|").alias("categories"),
        F.array_join("missing", "|").alias("missing")
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of all articles; every fourth entry has no date, every seventh is of another host."""
    loc = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("https://other.example.org/"), F.col("external_id"))).otherwise(F.col("url"))
    date = F.when(
        F.col("event_id") % 4 != 0, element("lastmod", F.date_format("publication_datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ).otherwise("")
    body = element("url", F.concat(element("loc", escaped(loc)), date))
    return joined(fx.articles(spark, sf_dir), body).select(
        "doc_id", element("urlset", F.col("inside")).alias("body"),
        F.concat(F.lit("https://www."), F.col("doc_id"), F.lit(".example.com/")).alias("base_url")
    )


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.sitemap_entries(sitemaps(spark, sf_dir), 12)
    return rows.select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "link", F.col("published_at").cast("timestamp_ntz").alias("published_at")
    )


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over values with known results."""
    a = fx.articles(spark, sf_dir)
    return a.select(
        "external_id", text.normalize_url(F.concat(F.col("url"), F.lit("/?utm_source=x&b=2&amp;a=1&fbclid=z#top"))).alias("address"), text.feed_id("stable_id", "url").alias("feed_id"),
        text.plain_text(F.concat(F.lit("  A &amp;amp; B  "), F.coalesce("title_original", F.lit("")))).alias("plain"), text.folded(F.concat(F.lit("Élan "), F.col("source"))).alias("folded"),
        text.title_from_link(F.concat(F.lit("https://e.org/2024/05/mayor-of_"), F.col("language_hint"), F.lit("-id12.html"))).alias("linked_title"),
        text.loose_date(F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss 'CET'")).cast("timestamp_ntz").alias("moment"),
        x.date_in_url(F.concat(F.col("url"), F.lit("/2024/02/0"), (F.col("event_id") % 4).cast("string"), F.lit("/x"))).alias("day"),
        x.relative_age(F.concat((F.col("event_id") % 50).cast("string"), F.lit(" hours  ago")), at(AS_OF)).alias("since"),
    )


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as pages: a third tells its section in metadata, a third in breadcrumbs, some in keywords, the rest nowhere."""
    a, k = fx.articles(spark, sf_dir), F.col("event_id")
    meta = F.concat(F.lit('<meta property="article:section" content="'), F.col("language_hint"), F.lit('">'))
    crumb = F.concat(
        F.lit('<script type="application/ld+json">{"breadcrumb":{"itemListElement":[{"name":"Home"},{"item":{"name":"'),
        F.col("language_hint"), F.lit(' pages"}}]}}</script>')
    )
    words = F.concat(F.lit('<meta name="keywords" content="nothing, '), F.col("language_hint"), F.lit(' one">'))
    head = F.concat(
        F.when(k % 3 == 0, meta).otherwise(""), F.when(k % 3 == 1, crumb).otherwise(""), F.when(k % 2 == 0, words).otherwise("")
    )
    context = F.when(k % 5 == 0, F.concat(F.lit("https://e.org/x/"), F.col("external_id"))).otherwise(F.col("url"))
    return a.select(
        F.col("external_id").alias("page_id"), F.concat(F.lit("<html><head>"), head, F.lit("</head></html>")).alias("html"),
        context.alias("url")
    )


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = marked_pages(spark, sf_dir)
    return taxonomy.page_sections(pages, feeds.page_signal_order(pages))


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap index for each source that names a file for each article: names and dates of several kinds, some relative."""
    k = F.col("event_id")
    site, i = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")), k.cast("string")
    names = [
        "/sitemap/news/%.xml", "/a%/video-sitemap.xml", "/a%/news-sitemap.xml.gz", "/tag-%.xml", "/2024/01/x%.xml", "/2023-11/z%.xml",
        "/posts/%.xml", "/plain-%.xml"
    ]
    loc = F.replace(F.element_at(F.array(*[F.lit(n) for n in names]), (k % 8 + 1).cast("int")), F.lit("%"), i)
    date = F.when(k % 5 == 0, F.lit("2023-10-01T00:00:00Z")).when(
        k % 3 != 0, F.date_format("publication_datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    body = element(
        "sitemap",
        F.concat(element("loc", F.when(k % 7 == 0, loc).otherwise(F.concat(site, loc))), F.coalesce(element("lastmod", date), F.lit("")))
    )
    whole = joined(fx.articles(spark, sf_dir), body)
    return whole.select(
        F.col("doc_id").alias("source"), F.concat(F.lit("https://"), F.col("doc_id"), F.lit(".example.com/index.xml")).alias("url"),
        element("sitemapindex", F.col("inside")).alias("body")
    )


def sitemap_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maps.children(indexes(spark, sf_dir), at(AS_OF), of=["source"], limit=24)
    return found.select("source", "loc", "score", F.col("rank").cast("long").alias("rank"))


def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each source's first index through indexes that name the next one, the one before, a sitemap, one of tags and one that
    has not landed."""
    sources = fx.articles(spark, sf_dir).select("source").distinct()
    url = lambda k, name: F.concat(
        F.lit("https://"), F.col("source"), F.lit(".example.com/sitemap/news/"), F.lit(name), k.cast("string"), F.lit(".xml")
    )
    n = F.col("n")
    child = lambda c: element("sitemap", element("loc", c))
    each = sources.select("source", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n"))
    named = F.concat(
        child(url(n + 1, "index-")), child(url(n - 1, "index-")), child(F.concat(F.lit("leaf-"), n.cast("string"), F.lit(".xml"))),
        child(url(n, "tag-")), child(url(n, "lost-"))
    )
    index = each.select(url(n, "index-").alias("url"), element("sitemapindex", named).alias("body"))
    leaves = each.select(F.explode(F.array(url(n, "leaf-"), url(n, "tag-"))).alias("url"), F.lit("<urlset></urlset>").alias("body"))
    roots = sources.select(F.col("source").alias("root"), url(F.lit(0), "index-").alias("url"))
    return maps.expanded(roots, index.unionByName(leaves), at(AS_OF)).select("root", "url", F.col("depth").cast("long").alias("depth"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed ids from the feeds of all articles, which give every second one without an id another."""
    a = fx.articles(spark, sf_dir)
    items = a.filter("event_id % 2 = 0").select(
        "source", F.col("url").alias("link"), F.concat(F.lit("late-"), F.col("external_id")).alias("feed_id")
    )
    return repair.stable_id_backfill(a, items)


QUERIES = {
    "sc06_sitemap_tree": sitemap_tree, "sc06_sitemap_children": sitemap_children, "sc07_page_sections": page_sections,
    "m12_stable_ids": stable_ids, "sc03_feed_items": feed_items, "sc04_sitemap_entries": sitemap_entries, "x_text_values": text_values
}
