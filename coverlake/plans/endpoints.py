"""Endpoints of sources by kind, coordinates with a stable offset, words of addresses, and the news API's reading with all bounds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, visible
from ..functions.scalars import path
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF
from .audit import listed

# What an address tells of the kind of a sitemap, and the profiles of sources.
INDEX = r"(?:^|[/?._-])sitemap(?:_|-)?index(?:\.xml|$|[?#])|/sitemaps/index|sitemapindex"
NEWS = r"news-sitemap|sitemap-news|sitemap_news|google-news|google_news|googlenews|map_news|(?:^|[/?._-])news\.xml(?:$|[?#])|48hrs|48-hours"
PROFILES = (
    "rss_only", "news_sitemap_only", "sitemap_index_only", "other_sitemap_only", "rss_plus_news_sitemap", "rss_plus_sitemap_index",
    "rss_plus_other_sitemap"
)
#: Least and greatest offset in degrees by how a place is known.
JITTER = {"country": (0.2, 1.05), "city": (0.01, 0.075), "headquarters": (0.0015, 0.012)}
#: Words of addresses that tell nothing.
STOP = (
    "www", "com", "html", "amp", "news", "article", "articles", "story", "stories", "video", "latest", "index", "sitemap", "google",
    "newsxml"
)
FUTURE_MINUTES = 15


def sitemap_kind(url: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.when(low == "", "none").when(
        low.rlike(INDEX), "sitemap_index"
    ).when(low.rlike(NEWS), "news_sitemap").otherwise("other_sitemap")


def endpoint_profile(rss: Column, sitemap: Column) -> Column:
    kind, has_rss = sitemap_kind(sitemap), F.trim(F.coalesce(rss, F.lit(""))) != ""
    return F.when(kind == "none", "rss_only").when(has_rss, F.concat(F.lit("rss_plus_"), kind)).otherwise(F.concat(kind, F.lit("_only")))


def endpoint_breakdown(sources: DataFrame) -> DataFrame:
    """sources: country, rss, sitemap. How many of each country have which of the seven profiles."""
    profile = endpoint_profile(F.col("rss"), F.col("sitemap"))
    return sources.groupBy("country").agg(*[F.count_if(profile == p).alias(p) for p in PROFILES])


def jittered(lat: Column, lon: Column, seed: Column, profile: Column) -> tuple[Column, Column]:
    """A point moved by a small offset that depends on its seed alone, so that places of one city do not cover each other."""
    number = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long")
    bound = lambda k: F.create_map(*[F.lit(x) for name, b in JITTER.items() for x in (name, b[k])])[profile]
    angle = (number % 360) * F.lit(3.141592653589793 / 180)
    radius = bound(0) + (F.shiftright(number, 8) % 100) / 100 * (bound(1) - bound(0))
    wide = F.greatest(F.lit(0.35), F.cos(lat * F.lit(3.141592653589793) / 180))
    return F.round(lat + F.sin(angle) * radius, 4), F.round(lon + F.cos(angle) * radius * wide, 4)


def url_words(url: Column) -> Column:
    """Distinct words of an address's host and path, in order; none that only number or name a part of a site."""
    # a plus is no space in a path
    place = F.replace(path(url), F.lit("+"), F.lit("%2B"))
    low = F.lower(
        F.concat(
            F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")), F.lit(" "),
            F.coalesce(F.try_url_decode(place), place)
        )
    )
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(*STOP) & ~w.rlike("^[0-9]+$"))


def word_predictions(articles: DataFrame, least_support: int = 3, least_share: float = 0.4) -> DataFrame:
    """Categories that a word of a source's addresses predicts: share of the word's articles that have the category."""
    told = articles.filter(F.size("feed_categories") > 0).select(
        F.trim("source").alias("source"), url_words(F.col("url")).alias("words"), F.array_distinct("feed_categories").alias("categories")
    )
    samples = told.select(
        "source", F.explode("words").alias("word")
    ).groupBy("source", "word").agg(F.count("*").alias("samples")).filter(F.col("samples") >= least_support)
    pairs = told.select("source", F.explode("words").alias("word"), "categories").select(
        "source", "word", F.explode("categories").alias("category")
    )
    counted = pairs.groupBy("source", "word", "category").agg(F.count("*").alias("support"))
    share = F.round(F.col("support") / F.col("samples"), 6)
    return counted.join(samples, ["source", "word"]).withColumn("share", share).filter(F.col("share") >= least_share)


@dataclass(frozen=True)
class NewsRead:
    """Options of the news API; bounds of the page are clamped, blank entries of lists go. Without any bound of time the last
    ``hours`` count."""

    text: str = ""
    sources: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    published: tuple[str | None, str | None] = (None, None)
    created: tuple[str | None, str | None] = (None, None)
    updated: tuple[str | None, str | None] = (None, None)
    hours: int = 48
    limit: int = 100
    offset: int = 0

    def filters(self, as_of: str) -> list[Column]:
        claimed = F.least("publication_datetime", "created_at")
        out = [visible(), claimed <= at(as_of) + F.make_dt_interval(mins=F.lit(FUTURE_MINUTES))]
        for column, values in (("source", self.sources), ("country", self.countries), ("language", self.languages)):
            if kept := listed(values):
                out.append(F.col(column).isin(kept))
        if kept := listed(self.sections):
            of = F.coalesce("sections_normalized", F.array().cast("array<string>"))
            out.append(
                F.arrays_overlap(of, F.array(*[F.lit(x) for x in kept])) | (F.size(of) == 0) & blank_to("section", "others").isin(kept)
            )
        if q := self.text.strip()[:120].replace("\\", "\\\\"):  # % and _ are wild cards, a backslash is none
            told = [
                F.coalesce("title_original", F.lit("")), F.col("source"), F.coalesce("country", F.lit("")),
                F.coalesce(F.array_join("feed_categories", " "), F.lit(""))
            ]
            out.append(reduce(or_, [c.ilike(f"%{q}%") for c in told]))
        bounds = [(claimed, self.published), (F.col("created_at"), self.created), (F.col("updated_at"), self.updated)]
        for column, (first, last) in bounds:
            if first:
                out.append(column >= at(first))
            if last:
                out.append(column <= at(last))
        if not any(b for _, both in bounds for b in both):
            out.append(claimed > before(as_of, f"{min(max(self.hours, 1), 720)} hours"))
        return out


def news_page(articles: DataFrame, query: NewsRead, as_of: str) -> DataFrame:
    """One page, newest first, with the total and whether there is more."""
    size = min(max(query.limit, 1), 200)
    rows = articles.filter(reduce(and_, query.filters(as_of)))
    claimed = F.least("publication_datetime", "created_at")
    page = rows.orderBy(claimed.desc(), F.desc("created_at"), F.asc("external_id")).offset(max(query.offset, 0)).limit(size)
    shown = page.select("external_id", "source", "language", "country", claimed.alias("published_at"), "updated_at")
    total = rows.agg(F.count("*").alias("total"))  # one row
    return shown.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > max(query.offset, 0) + size)


def filter_lists(articles: DataFrame) -> DataFrame:
    """Distinct values of visible articles by kind, in order of their small letters: (kind, place from 1, value)."""
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.trim(c).alias("value"))
            for kind, c in (("country", "country"), ("language", "language"), ("source", "source"))
        ]
    )
    values = articles.filter(visible()).select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value") != "").distinct()
    # what is shown as a list of filters is as long as there are sources
    order = W.partitionBy("kind").orderBy(F.lower("value"), "value")
    return values.select("kind", F.row_number().over(order).cast("long").alias("place"), "value")


def with_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a language, some blank, and the time of their last change."""
    a = fx.articles(spark, sf_dir)
    language = F.expr(
        "case when event_id % 9 = 0 then ' ' when event_id % 10 = 0 then null else element_at(array('en', 'De', 'fr ', 'es'), cast(event_id % 4 as int) + 1) end"
    )
    return a.withColumn("language", language).withColumn(
        "updated_at", F.expr("created_at + make_dt_interval(0, cast(event_id % 50 as int))")
    )


def endpoints_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each supplier, with addresses of several kinds."""
    s = fx.load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    names = [
        "", "/sitemap-index.xml", "/news-sitemap.xml", "/sitemap.xml", "/maps/NEWS.xml?x=1", "/sitemaps/index-2.xml", "/map_news/1", None
    ]
    site = F.concat(F.lit("https://src"), k.cast("string"), F.lit(".example.com"))
    name = F.get(F.array(*[F.lit(n) for n in names]), (k % 8).cast("int"))
    return s.select(
        F.concat(F.lit("src"), k.cast("string")).alias("source"), F.concat(F.lit("C"), (k % 7).cast("string")).alias("country"),
        F.when(k % 3 != 0, F.concat(site, F.lit("/rss"))).alias("rss"),
        F.when(name != "", F.concat(site, name)).otherwise(name).alias("sitemap"), k.alias("n")
    )


def sitemap_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = endpoints_of(spark, sf_dir)
    return e.select(
        "source", sitemap_kind(F.col("sitemap")).alias("kind"), endpoint_profile(F.col("rss"), F.col("sitemap")).alias("profile")
    )


def moved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    profile = F.element_at(F.array(F.lit("country"), F.lit("city"), F.lit("headquarters")), (k % 3 + 1).cast("int"))
    lat, lon = jittered(
        (k % 170 - 85).cast("double"), (k % 360 - 180).cast("double"), F.concat_ws("|", "s_name", k.cast("string")), profile
    )
    return s.select("s_suppkey", lat.alias("lat"), lon.alias("lon"))


def words_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.articles(spark, sf_dir)
    url = F.concat(F.col("url"), F.lit("/Latest-"), F.col("source"), F.lit("/caf%C3%A9_2024+x1.html"))
    return a.select("external_id", F.array_join(F.array_sort(url_words(url)), ",").alias("words"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_predictions(fx.articles(spark, sf_dir))


def asked_watermarks(items: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """The newest publication of each endpoint (outlet_id, method) of a list of values; null where there is none."""
    spark = items.sparkSession
    wanted = spark.createDataFrame(asked, "outlet_id string, method string").distinct()
    found = items.join(F.broadcast(wanted), ["outlet_id", "method"], "left_semi").groupBy("outlet_id", "method")  # a list of values
    newest = found.agg(F.max("published_at").alias("last_publication_at"))
    return wanted.join(newest, ["outlet_id", "method"], "left")


def asked_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.runs(spark, sf_dir).select("outlet_id", "method", F.col("newest_item_published_at").alias("published_at"))
    return asked_watermarks(items, [(str(k), m) for k in (1, 2, 3, 5, 8, 13, 999) for m in ("rss", "sitemap")] + [("1", "rss")])


def headquarters(publishers: DataFrame, table: DataFrame) -> DataFrame:
    """publishers: publisher, country. table: at (its order), publisher, country, city, lat, lon. Each publisher's first seat in its
    country, by name without case and outer or double spaces."""
    name = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    seats = table.groupBy(name(F.col("publisher")).alias("_name"), F.col("country").alias("_country"))
    first = seats.agg(F.min_by(F.struct("city", "lat", "lon"), "at").alias("_seat"))
    beside = (name(F.col("publisher")) == F.col("_name")) & (F.col("country") == F.col("_country"))
    return publishers.join(first, beside, "left").select("publisher", "country", "_seat.city", "_seat.lat", "_seat.lon")


def seats_of_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers spelled in two ways, and a table of seats with some twice."""
    s = fx.load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    land = F.concat(F.lit("C"), (k % 4).cast("string"))
    asked = s.select(
        F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper("s_name"))).otherwise(F.col("s_name")).alias("publisher"), land.alias("country")
    )
    seat = lambda at, where, town: s.select(
        (at * 1000000 + k).alias("at"), F.col("s_name").alias("publisher"), where.alias("country"),
        F.concat(F.lit(town), k.cast("string")).alias("city"), (k + at).cast("double").alias("lat"), (-k).cast("double").alias("lon")
    )
    table = seat(2, land, "Second ").unionByName(seat(1, F.when(k % 3 == 0, "C9").otherwise(land), "First ").filter(k % 5 > 0))
    return headquarters(asked, table)


READ = NewsRead(
    text="k1", sources=["src1, src2", "src3"], languages=["en", "De"], sections=["world", "sports, business"],
    published=("2024-01-03 00:00:00", "2024-01-19 12:00:00"), created=("2024-01-02 00:00:00", None), updated=(None, "2024-01-20 00:00:00"),
    limit=40, offset=0
)


def read_page(spark: SparkSession, sf_dir: str, query: NewsRead = READ) -> DataFrame:
    return news_page(with_language(spark, sf_dir), query, AS_OF)


def read_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_page(spark, sf_dir, NewsRead(hours=96, limit=25, offset=10))


def all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_lists(with_language(spark, sf_dir))


QUERIES = {
    "sc10_asked_watermarks": asked_endpoints, "x38_headquarters": seats_of_publishers,
    "a24_endpoint_profiles": lambda spark, sf_dir: endpoint_breakdown(endpoints_of(spark, sf_dir)), "x40_sitemap_kinds": sitemap_kinds,
    "x35_moved_places": moved_places, "x49_url_words": words_of_addresses, "q52_word_predictions": predictions, "q10_news_read": read_page,
    "q10_news_recent": read_recent, "q11_filter_lists": all_filters
}
