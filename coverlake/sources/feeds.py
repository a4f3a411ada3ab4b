"""Landed feed documents to rows: RSS and Atom items, sitemap entries and page signals, by Column expressions.

A document is one row (doc_id, body); items come out by splitting it at start tags and exploding the parts, so each stage is a
plain projection and Spark spreads it like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import date_in_url, host
from ..functions.text import loose_date, plain_text, title_from_link

LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: What an item should have; those it lacks are listed.
WANTED = ["title", "link", "description", "published_at"]


def opening(name: str) -> str:
    """Start tags of this name, with or without a prefix."""
    return rf"(?i)<(?:[a-z0-9_.-]+:)?{name}(?:\s[^>]*)?>"


def closing(name: str) -> str:
    return rf"(?i)</(?:[a-z0-9_.-]+:)?{name}\s*>"


def elements(body: Column, name: str, closed: bool = True) -> Column:
    """What stands in each element of this name: the text is split at its start tags, and each part ends at the first end tag.
    Elements that are not closed end where the next begins, or are left out."""
    parts = F.split(body, opening(name))
    after = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    if closed:
        after = F.filter(after, lambda x: x.rlike(closing(name)))
    return F.transform(after, lambda x: F.split(x, closing(name), 2)[0])


def plain(inner: Column) -> Column:
    """Without CDATA marks and tags."""
    bare = F.regexp_replace(inner, r"<!\[CDATA\[|\]\]>", "")
    return F.trim(F.regexp_replace(bare, r"<[^>]*>", " "))


def tag(body: Column, name: str) -> Column:
    """Text of the first such element; empty without one."""
    return F.coalesce(plain(F.get(elements(body, name), 0)), F.lit(""))


def attribute(body: Column, name: str, key: str) -> Column:
    """The quoted value of an attribute of the first such start tag that has it; empty without one."""
    return F.regexp_extract(body, rf"""(?i)<{name}\s(?:[^>]*?\s)?{key}\s*=\s*["']([^"']+)["']""", 1)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a nested catalog: the first address of each kind in file order; a publisher class wins."""
    feeds = spark.read.json(path, multiLine=True).select(F.explode("countries").alias("c")).select(
        F.col("c.name").alias("country"), F.posexplode("c.feeds").alias("at", "f")
    )
    rows = feeds.select(
        "country", F.col("f.name").alias("source"), "at", F.col("f.url").alias("url"), F.col("f.sitemapUrl").alias("sitemap"),
        F.coalesce("f.distributionClass", F.lit("publisher")).alias("class")
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return rows.groupBy("country", "source").agg(
        first("url").alias("url"), first("sitemap").alias("sitemap"), F.max("class").alias("distribution_class")
    )


def feed_items(documents: DataFrame, limit: int = 10) -> DataFrame:
    """Items of RSS feeds, or entries of Atom feeds where there are none; the limit comes before what is wanted of them."""
    found = documents.select("doc_id", elements(F.col("body"), "item").alias("items"), elements(F.col("body"), "entry").alias("entries"))
    rss = F.size("items") > 0
    blocks = found.select(
        "doc_id", rss.alias("rss"),
        F.posexplode(F.slice(F.when(rss, F.col("items")).otherwise(F.col("entries")), 1, limit)).alias("at", "body")
    )
    body = F.col("body")
    first = lambda *names: F.coalesce(*[F.nullif(tag(body, n), F.lit("")) for n in names])
    link = F.when(F.col("rss"), tag(body, "link")).otherwise(attribute(body, "link", "href"))
    rows = blocks.select(
        "doc_id", "at", F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(link).alias("link"), plain_text(tag(body, "title")).alias("title"),
        plain_text(F.coalesce(first("description", "summary", "content"), F.lit(""))).alias("description"),
        first("pubDate", "published", "updated", "date").alias("_date"), first("guid", "id").alias("feed_id"), F.transform(elements(body, "category"), plain).alias("categories"),
    )
    dated = rows.withColumn("published_at", F.coalesce(loose_date("_date"), date_in_url(F.col("link")).cast("timestamp"))).drop("_date")
    lacks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in WANTED]
    return dated.withColumn("missing", F.array_compact(F.array(*lacks)))


def sitemap_entries(documents: DataFrame, limit: int = 12) -> DataFrame:
    """Entries of sitemaps (doc_id, body, base_url), newest first, undated last; other hosts' entries go."""
    found = documents.select(
        "doc_id", "base_url", elements(F.col("body"), "url").alias("closed"), elements(F.col("body"), "url", closed=False).alias("all")
    )
    blocks = found.select(
        "doc_id", "base_url", F.posexplode(F.when(F.size("closed") > 0, F.col("closed")).otherwise(F.col("all"))).alias("at", "body")
    )
    body = F.col("body")
    rows = blocks.select(
        "doc_id", "base_url", "at", plain_text(tag(body, "loc")).alias("link"), plain_text(tag(body, "title")).alias("_title"),
        F.coalesce(F.nullif(tag(body, "publication_date"), F.lit("")), F.nullif(tag(body, "lastmod"), F.lit(""))).alias("_date")
    )
    a, b = host(F.col("link")), host(F.col("base_url"))
    same = (a == "") | F.coalesce(b == "", F.lit(True)) | (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    kept = rows.filter(same).withColumn("published_at", F.coalesce(loose_date("_date"), date_in_url(F.col("link")).cast("timestamp")))
    titled = kept.withColumn(
        "title", F.coalesce(F.nullif("_title", F.lit("")), F.nullif(title_from_link("link"), F.lit("")), F.col("link"))
    )
    ranked = titled.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc_nulls_last("published_at"), "at")))
    return ranked.filter(F.col("rank") <= limit).select("doc_id", "rank", "link", "title", "published_at")


def page_signals(pages: DataFrame) -> DataFrame:
    """Categories and section that pages name, from meta elements and JSON-LD."""
    h = F.col("html")
    meta = F.regexp_extract(h, r"""(?is)<meta[^>]+property=["']article:section["'][^>]+content=["']([^"']*)["']""", 1)
    tags = F.regexp_extract_all(h, F.lit(r"""(?is)<meta[^>]+property=["']article:tag["'][^>]+content=["']([^"']*)["']"""), F.lit(1))
    ld = F.regexp_extract(h, LD, 1)
    section = F.coalesce(F.nullif(meta, F.lit("")), F.get_json_object(ld, "$.articleSection"), F.get_json_object(ld, "$.articleSection[0]"))
    return pages.select(
        "page_id", section.alias("section"), tags.alias("categories"),
        F.coalesce(
            F.get_json_object(ld, "$.datePublished"),
            F.nullif(F.regexp_extract(h, r"""(?is)<time[^>]+datetime=["']([^"']*)["']""", 1), F.lit(""))
        ).alias("date")
    )


def page_signal_order(pages: DataFrame) -> DataFrame:
    """(page_id, kind, place, signal): what a page says of its section, in the order in which it counts: metadata and the
    article's section, then breadcrumbs, then keywords."""
    h = F.col("html")
    ld = F.regexp_extract(h, LD, 1)
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (F.trim(x) != ""))
    many = lambda p: F.coalesce(F.from_json(F.get_json_object(ld, p), "array<string>"), one(F.get_json_object(ld, p)))
    meta = one(F.regexp_extract(h, r"""(?is)<meta[^>]+property=["']article:section["'][^>]+content=["']([^"']*)["']""", 1))
    crumbs = F.from_json(F.get_json_object(ld, "$.breadcrumb.itemListElement"), "array<struct<name:string,item:struct<name:string>>>")
    words = F.split(F.regexp_extract(h, r"""(?is)<meta[^>]+name=["'](?:news_)?keywords["'][^>]+content=["']([^"']*)["']""", 1), r"\s*,\s*")
    kinds = [
        ("meta", F.concat(meta, many("$.articleSection"))),
        ("breadcrumb", F.transform(crumbs, lambda x: F.coalesce(x["name"], x["item"]["name"]))),
        ("keywords", F.concat(words, many("$.keywords")))
    ]
    each = F.array(
        *[
            F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), F.coalesce(v, F.array().cast("array<string>")).alias("signals"))
            for k, (kind, v) in enumerate(kinds)
        ]
    )
    rows = pages.select("page_id", F.explode(each).alias("k")).select(
        "page_id", "k.rank", "k.kind", F.posexplode("k.signals").alias("place", "signal")
    )
    return rows.withColumn("signal", F.trim("signal")).filter("signal <> ''")


def collection_items(pages: DataFrame, limit: int = 50) -> DataFrame:
    """List entries of pages' JSON-LD item lists, the first of each address kept."""
    item = "array<struct<position:int,url:string,name:string,item:struct<url:string,name:string,datePublished:string>>>"
    lists = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LD), F.lit(1))).alias("ld"))
    each = lists.select("page_id", F.posexplode(F.from_json(F.get_json_object("ld", "$.itemListElement"), item)).alias("at", "x"))
    rows = each.select(
        "page_id", "at", F.coalesce("x.url", "x.item.url").alias("link"), F.coalesce("x.name", "x.item.name").alias("title"),
        F.col("x.item.datePublished").alias("date")
    ).filter("link is not null")
    first = rows.withColumn("_rn", F.row_number().over(W.partitionBy("page_id", "link").orderBy("at"))).filter("_rn = 1")
    return first.withColumn(
        "rank", F.row_number().over(W.partitionBy("page_id").orderBy("at"))
    ).filter(F.col("rank") <= limit).select("page_id", "rank", "link", "title", "date")
