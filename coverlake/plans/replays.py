"""Forms of what streams and stores do that run over the tables at once: batches that come again, lateness, snapshots, list pages,
structured data of pages, landed bytes and addresses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..functions import text
from ..functions.exprs import at
from ..operators import merge, snapshots, stages
from ..sources import fixtures as fx
from ..sources import charset, feeds, listpages, pagedata
from ..sources.fixtures import AS_OF
from ..streaming import late, ledger
from . import dossier, ingest
from .landed import element, escaped, joined

KEYS, COUNTERS = ["bucket", "runner", "outlet_id", "method"], ["attempted_runs", "failed_runs", "fetched_count"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{stages.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def counted(runs: DataFrame) -> DataFrame:
    one = lambda c: c.cast("long")
    return runs.select(
        "id", F.date_trunc("hour", "ran_at").cast("timestamp_ntz").alias("bucket"), "runner", "outlet_id", "method",
        one(F.col("attempted")).alias("attempted_runs"), one(F.col("attempted") & ~F.col("ok")).alias("failed_runs"),
        F.coalesce("fetched_count", F.lit(0).cast("long")).alias("fetched_count")
    )


def rollup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of attempts appended with their rollup, one of them twice, one again after the base has taken it in."""
    rows, path = counted(fx.runs(spark, sf_dir)), fresh_path(spark, "ledger")
    batch = lambda k: rows.filter(F.col("id") % 4 == k)
    for k in (0, 1, 1):
        ledger.append(batch(k), path, k, KEYS, COUNTERS)
    ledger.compact(spark, path, KEYS, COUNTERS)
    for k in (2, 0, 3, 2):
        ledger.append(batch(k), path, k, KEYS, COUNTERS)
    sums = ledger.read_sums(spark, path, KEYS, COUNTERS)
    appended = ledger.read_rows(spark, path).groupBy(*KEYS).agg(F.count("*").alias("diagnostics"))
    return sums.join(appended, KEYS)


def lateness_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.by_day(aged(spark, sf_dir))


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of which some claim to be weeks old, and some nothing."""
    a = fx.articles(spark, sf_dir)
    return a.withColumn(
        "publication_datetime",
        F.expr(
            "case when event_id % 12 = 0 then null when event_id % 8 = 0 then created_at - interval 9 days when event_id % 16 = 4 then created_at - interval 7 days else publication_datetime end"
        )
    )


def lateness_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches landed by lateness, the second twice: what is kept, by lateness, and what was counted."""
    rows, path = aged(spark, sf_dir).select("event_id", "publication_datetime", "created_at"), fresh_path(spark, "late")
    land = late.land(path)
    for k in (0, 1, 1, 2):
        land(rows.filter(F.col("event_id") % 3 == k), k)
    kept = spark.read.parquet(f"{path}/items").groupBy("lateness").agg(F.count("*").alias("kept"))
    seen = spark.read.parquet(f"{path}/counts").groupBy("lateness").agg(F.sum("n").alias("seen"))
    return seen.join(kept, "lateness", "left").select("lateness", "seen", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


def variant_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of publisher countries for two windows, one of them replaced: the entries of the newest."""
    path, a = fresh_path(spark, "snapshots"), fx.articles(spark, sf_dir)
    rows = lambda hours: a.filter(F.col("created_at") >= at(AS_OF) - F.make_dt_interval(hours=F.lit(hours))).filter(F.col("created_at") <= at(AS_OF)).groupBy(F.coalesce("country", F.lit("Global")).alias("country")).agg(
        F.count("*").alias("articles"), F.countDistinct("source").alias("sources")
    )
    for window, hours, day in (("24h", 24, "2024-01-18"), ("7d", 168, "2024-01-19"), ("24h", 24, "2024-01-20")):
        some = rows(hours) if day != "2024-01-18" else rows(hours).limit(1)
        snapshots.write(snapshots.snapshot(some, window, "v1", at(f"{day} 00:00:00"), ["country"]), path)
    out = snapshots.entries(snapshots.read(spark, path), {"country": "string", "articles": "long", "sources": "long", "nothing": "string"})
    return out.select(
        "metric_window", "metric_version", "generated_at", F.col("place").cast("long").alias("place"), "country", "articles", "sources",
        "nothing"
    )


EXTRACTORS = [
    {"name": "cards", "host": "s1.example.com", "shape": "blocks", "item": "div.list > article.card[data-id]", "link": "h2 a@href", "title": "h2", "date": "time@datetime"},
    {"name": "dated", "host": "s2.example.com", "shape": "links", "pattern": r"^/n/(?P<date>20\d{2}-\d{2}-\d{2})/\d+$", "within": "ul#latest"},
    {"name": "state", "host": "s3.example.com", "shape": "script", "begins": r"window\.__STATE__\s*=\s*", "items": "front.items", "link": "uuid", "title": "headline.plain", "date": "publishedAt", "prefix": "/artikel/"},
]


def list_page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each source that lists its articles: by structured data, as cards, as dated links or in a script's state."""
    a, i = fx.articles(spark, sf_dir), F.col("external_id")
    kind = F.substring("source", 4, 9).cast("int") % 4
    title = F.concat(F.lit("No "), i, F.lit(" <& of "), F.col("language_hint"))
    stamp, day = F.date_format("publication_datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("publication_datetime", "yyyy-MM-dd")
    card = F.concat(
        F.lit('<article class="wide card" data-id='), i, F.lit('><h2><a href="/a/'), i, F.lit('">'), escaped(title),
        F.lit("</a></h2><time datetime='"), stamp, F.lit("'>then</time><p>text</article>")
    )
    link = F.concat(
        F.lit('<li><a href="/n/'), day, F.lit("/"), i, F.lit('"><b>'), escaped(title), F.lit("</b></a><a href=/tag/x>tag</a></li>")
    )
    entry = F.to_json(F.struct(i.alias("uuid"), F.struct(title.alias("plain")).alias("headline"), stamp.alias("publishedAt")))
    data = F.to_json(
        F.struct(
            F.lit("ListItem").alias("@type"),
            F.struct(F.concat(F.lit("/d/"), i).alias("url"), title.alias("headline"), stamp.alias("datePublished")).alias("item")
        )
    )
    each = a.withColumn("_b", F.when(kind == 0, data).when(kind == 1, card).when(kind == 2, link).otherwise(entry))
    whole = joined(each, F.concat(F.col("_b"), F.when(kind.isin(0, 3), ",").otherwise("")))
    k = F.substring("doc_id", 4, 9).cast("int") % 4
    inner = F.regexp_replace("inside", ",$", "")
    ld = F.concat(
        F.lit(
            '<script type="application/ld+json">{"@graph":[{"@type":["CollectionPage"],"mainEntity":{"@type":"ItemList","itemListElement":['
        ),
        inner, F.lit("]}}]}</script>")
    )
    state = F.concat(F.lit('<script>var x=1; window.__STATE__ = {"front":{"items":['), inner, F.lit("]}};</script>"))
    cards, links = F.concat(
        F.lit('<div class="list">'), inner, F.lit("<aside><article class=card><h2>No</h2></article></aside></div>")
    ), F.concat(F.lit('<a href="/n/2024-01-01/1">no</a><ul id="latest">'), inner, F.lit("</ul>"))
    body = F.when(k == 0, ld).when(k == 1, cards).when(k == 2, links).otherwise(state)
    return whole.select(
        F.col("doc_id").alias("source"),
        F.concat(F.lit("https://www."), F.col("doc_id"), F.lit(".s"), k.cast("string"), F.lit(".example.com/front/")).alias("url"),
        element("html", element("body", body)).alias("html")
    )


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listpages.list_items(list_page_html(spark, sf_dir), EXTRACTORS, limit=20)
    return rows.select(
        "source", "extractor", F.col("rank").cast("long").alias("rank"), "link", "title", F.col("date").cast("timestamp_ntz").alias("date")
    )


def data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as pages with several scripts: a broken one, a list, a graph; and metadata in either order of attributes."""
    a, k = fx.articles(spark, sf_dir), F.col("event_id")
    hint = F.col("language_hint")
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    graph = script(
        F.concat(
            F.lit('{"@context":"x","@graph":[{"@type":"WebSite","name":"s"},{"@type":["NewsArticle"],"articleSection":["'), hint,
            F.lit('","  "],"keywords":"k1, '), hint,
            F.lit('"},{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"item":{"name":"'), hint, F.lit(' pages"}}]}]}')
        )
    )
    listed = script(
        F.concat(
            F.lit('[{"@type":"NewsArticle","articleSection":"'), hint, F.lit(' one"},{"@type":"Thing","keywords":["a  b","'), hint,
            F.lit('"]}]')
        )
    )
    meta = F.concat(
        F.lit("<meta content='"), hint, F.lit(" &amp; more' property='article:section'><meta name=\"keywords\" content=\"x; y, ,"), hint,
        F.lit('">')
    )
    head = F.concat(
        F.when(k % 2 == 0, script(F.lit("{broken"))).otherwise(""), F.when(k % 3 == 0, graph).otherwise(""),
        F.when(k % 5 < 2, listed).otherwise(""), F.when(k % 4 == 1, meta).otherwise("")
    )
    return a.select(F.col("external_id").alias("page_id"), F.concat(F.lit("<html><head>"), head, F.lit("</head></html>")).alias("html"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of a page in order, as one text."""
    each = pagedata.signals(data_pages(spark, sf_dir))
    told = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "place", "kind", "signal"))), lambda r: F.concat_ws(":", r["kind"], r["signal"])
        ),
        "|"
    )
    return each.groupBy("page_id").agg(told.alias("signals"), F.count("*").alias("n"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with capitals, ports, dot segments, other scripts and tracking, in their one form."""
    a, k = fx.articles(spark, sf_dir), F.col("event_id")
    start = F.element_at(
        F.array(F.lit("HTTPS://SRC"), F.lit("https://münchen.src"), F.lit("http:\\\\src"), F.lit("https://u@src")), (k % 4 + 1).cast("int")
    )
    port = F.when(k % 3 == 0, ":443").when(k % 3 == 1, ":8080").otherwise("")
    url = F.concat(
        start, F.col("k").cast("string"), F.lit(".example.com"), port, F.lit("/a/./b/%2E%2e/"), F.col("language_hint"),
        F.lit("/../c d/é//?z=1&utm_x=2&B="), F.col("external_id"), F.lit("&a=~ü#f")
    )
    return a.select("external_id", text.normalize_url(url).alias("address"))


def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by section, of which two sections are written anew: what it holds then."""
    path = fresh_path(spark, "sections")
    rows = fx.articles(spark, sf_dir).select(
        "external_id", F.coalesce(F.nullif("section", F.lit("")), F.lit("others")).alias("section"), F.lit(1).alias("version")
    )
    merge.replace_partitions(rows, path, ["section"])
    again = rows.filter(
        F.col("section").isin("world", "tech", "local") & (F.col("external_id").cast("long") % 3 == 0)
    ).withColumn("version", F.lit(2))
    merge.replace_partitions(again, path, ["section"])
    return spark.read.parquet(path).groupBy("section", "version").agg(F.count("*").alias("articles"))


def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles merged into a table in two batches by day, the second one twice: each is there once, as it was written."""
    path = fresh_path(spark, "articles")
    rows = fx.articles(spark, sf_dir).withColumn("stable_id", F.lit(None).cast("string")).select(
        *ingest.COLUMNS, F.col("event_id").alias("seq")
    )
    for k in (0, 1, 1):
        merge.merge_into(rows.filter(F.dayofmonth("created_at") % 2 == k), path, buckets=4)
    out = spark.read.parquet(path)
    return out.select("external_id", "source", "title_original", "created_at", F.array_join("topics", "|").alias("topics"))


def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source catalog written as one nested file and read again."""
    path, s = fresh_path(spark, "catalog"), fx.load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.concat(F.lit("src"), (k - k % 4).cast("string"))
    feed = F.struct(
        name.alias("name"), F.when(k % 4 > 0, F.concat(F.lit("https://e.org/"), k.cast("string"))).alias("url"),
        F.when(k % 4 != 1, F.concat(F.lit("https://m.org/"), k.cast("string"))).alias("sitemapUrl"),
        F.when(k % 4 == 2, "portal").alias("distributionClass")
    )
    feeds_of = s.groupBy((k % 100 - k % 4).alias("c")).agg(F.array_sort(F.collect_list(F.struct(k, feed.alias("f")))).alias("l"))
    lands = feeds_of.select(
        F.struct(
            F.concat(F.lit("C"), F.col("c").cast("string")).alias("name"), F.transform("l", lambda x: x["f"]).alias("feeds")
        ).alias("country")
    )
    lands.agg(F.to_json(F.struct(F.collect_list("country").alias("countries"))).alias("value")).coalesce(1).write.text(path)
    return feeds.read_catalog(spark, path)


def landed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts landed in several charsets, told by a byte mark, a header, a declaration or nothing."""
    a, k = fx.articles(spark, sf_dir), F.col("event_id")
    text_ = F.concat(F.lit("Größe é "), F.coalesce("title_original", F.lit("")))
    declared = F.concat(F.lit('<?xml version="1.0" encoding="iso-8859-1"?>'), text_)
    marked = lambda mark, c: F.concat(F.unhex(F.lit(mark)), c)
    body = F.when(k % 5 == 0, F.encode(text_, "UTF-8")).when(k % 5 == 1, F.encode(text_, "ISO-8859-1")).when(
        k % 5 == 2, marked("FFFE", F.encode(text_, "UTF-16LE"))
    ).when(k % 5 == 3, F.encode(declared, "ISO-8859-1")).otherwise(marked("EFBBBF", F.encode(text_, "UTF-8")))
    header = F.when(k % 5 == 1, "text/html; charset=ISO-8859-1").otherwise("")
    return a.select("external_id", charset.decoded(body, header).alias("body"))


def names_and_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.load(spark, sf_dir, "supplier")
    n = F.col("s_suppkey").cast("string")
    pick = lambda *values: F.element_at(F.array(*values), (F.col("s_suppkey") % len(values) + 1).cast("int"))
    address = pick(
        F.concat(F.lit(" https://www.Instagram.com/@Src"), n), F.concat(F.lit("@Src"), n), F.lit("no handle here"),
        F.concat(F.lit("http://x.com/src_"), n, F.lit("?lang=en")), F.lit(None).cast("string")
    )
    name = pick(
        F.concat(F.lit("Last"), n, F.lit(", First"), n), F.concat(F.lit("Name  (note)  X"), n, F.lit(" [b]")), F.lit(None).cast("string")
    )
    return s.select("s_suppkey", x.handle(address).alias("handle"), dossier.display_name(name).alias("name"))


QUERIES = {
    "m10_rollup_replay": rollup_replay, "st2_lateness": lateness_by_day, "st2_late_rows": lateness_landed, "sk5_variant_snapshots": variant_snapshots, "sc05_list_pages": list_pages, "sc07_all_signals": page_signals, "x01_addresses": addresses,
    "sk2_replaced_partitions": replaced_partitions, "sk1_merged_table": merged_table, "sc02_catalog_file": catalog_file, "sc09_landed_bytes": landed_bytes, "x51_names_and_handles": names_and_handles,
}
