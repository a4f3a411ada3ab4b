"""Sitemap indexes: the children that an index names, which of them are worth following, and the sitemaps they lead to.

The expansion is a frontier over landed documents. Each round reads the indexes of the last one, keeps the best children of each,
drops those that its root has visited, and joins the rest with the documents. What a round finds and has visited is stored,
so its plan is the same at any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import host, path
from ..functions.text import loose_date, plain_text
from ..operators.stages import stored
from .feeds import elements, tag

# What the names of files tell, and the points for it.
NEWS = r"(?:^|/)(?:newssitemap|news-sitemap|gnews_sitemap|gnews|google-news|google_news|sitemap_latest|latest)(?:\.xml(?:\.gz)?)?$"
VIDEO = r"(?:^|/)(?:videositemap|video-sitemap)(?:\.xml(?:\.gz)?)?$"
CONTENT = r"sitemap(?:[_-](?:main|content|post|posts))|/sitemap/news\b|/post-sitemap|/posts?\b|/articles?\b"
UTILITY = r"author|tag|toptag|top-tags|top_tags|weather|horoskop|horoscope|navigation|teemasivut|minisite|maintopics|main-topics|legacy-taxonomies|/site/sitemap"
POINTS = [(NEWS, 600), (VIDEO, 520), (CONTENT, 180), (UTILITY, -420)]
#: Fixed values, in days and points: (up to so old, points), (over so old, points) by last change and by the date in the address.
CHANGED, DATED = ((2, 220), (60, -120)), ((35, 80), (45, -220))
CHILDREN, DEPTH = 48, 4


def address_date(loc: Column) -> Column:
    """The month or day in an address: with slashes, else with hyphens, else in parameters named yyyy, mm, dd (or year, month, day)."""
    found = []
    for mark in ("/", "-"):
        pattern = rf"(20[0-9]{{2}}){mark}(0[1-9]|1[0-2]|[1-9])(?:{mark}(0[1-9]|[12][0-9]|3[01]|[1-9]))?(?=[^0-9]|$)"
        found.append([F.regexp_extract(loc, pattern, k) for k in (1, 2, 3)])
    value = lambda *names: F.coalesce(
        *[F.nullif(F.regexp_extract(loc, rf"[?&]{n}=([0-9]{{1,4}})", 1), F.lit("")) for n in names], F.lit("")
    )
    found.append([value("yyyy", "year"), value("mm", "month"), value("dd", "day")])
    dates = []
    for year, month, day in found:
        first = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")
        # a day beyond the month's end runs on into the next
        dates.append(
            F.when((year != "") & (month != ""), F.date_add(first, F.coalesce(F.nullif(day, F.lit("")).cast("int"), F.lit(1)) - 1))
        )
    return F.coalesce(*dates)


def number_at_end(loc: Column) -> Column:
    """The last number of an address; where it tells a start, less for later ones."""
    start = F.regexp_extract(loc, r"[?&](?:from|start)=([0-9]{1,15})", 1)
    last = F.regexp_extract(loc, r"([0-9]{1,15})[^0-9]*$", 1)
    return F.when(start != "", -start.cast("long")).when(last != "", last.cast("long"))


def resolved(loc: Column, base: Column) -> Column:
    """An address beside that of its document."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)[^/]*$", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    beside = F.when(loc.startswith("//"), F.concat(scheme, loc)).when(loc.startswith("/"), F.concat(origin, loc)).otherwise(
        F.concat(origin, F.when(folder == "", "/").otherwise(folder), loc)
    )
    return F.when(loc.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | F.coalesce(origin == "", F.lit(True)), loc).otherwise(beside)


def index_entries(documents: DataFrame) -> DataFrame:
    """documents: url, body, and any columns but these: at, loc, changed, dated, tail. Those but the body, with a row for each
    child that an index names."""
    rest = [c for c in documents.columns if c != "body"]
    body = F.col("body")
    inner = F.when(F.size(elements(body, "sitemap")) > 0, elements(body, "sitemap")).otherwise(elements(body, "sitemap", closed=False))
    blocks = documents.filter(body.rlike(r"(?i)<(?:[a-z0-9_.-]+:)?sitemapindex[\s>]")).select(*rest, F.posexplode(inner).alias("at", "_b"))
    rows = blocks.select(
        *rest, "at", resolved(plain_text(tag(F.col("_b"), "loc")), F.coalesce("url", F.lit(""))).alias("loc"),
        loose_date(F.nullif(tag(F.col("_b"), "lastmod"), F.lit(""))).alias("changed")
    )
    return rows.filter("loc <> ''").select("*", address_date(F.col("loc")).alias("dated"), number_at_end(F.col("loc")).alias("tail"))


def age_points(days: Column, points: tuple) -> Column:
    (fresh, more), (old, less) = points
    return F.when(days <= fresh, more).when(days > old, less).otherwise(0)


def score(now: Column) -> Column:
    low = F.lower("loc")
    seconds = F.unix_seconds(now.cast("timestamp"))
    named = reduce(lambda a, b: a + b, [F.when(low.rlike(pattern), points).otherwise(0) for pattern, points in POINTS])
    by_change = age_points((seconds - F.unix_seconds(F.col("changed").cast("timestamp"))) / 86400, CHANGED)
    by_date = age_points((seconds - F.unix_seconds(F.col("dated").cast("timestamp"))) / 86400, DATED)
    return (named + by_change + by_date).cast("int")


def children(documents: DataFrame, now: Column, *, of: list[str], limit: int = CHILDREN, hosts: DataFrame | None = None) -> DataFrame:
    """The children of each index (rows that share the columns ``of``) that are followed: those with a score above 0, best first,
    or all, newest first, where none has; at most ``limit``.

    hosts: (host, pattern, most): where a host has a rule and an address of the index matches it, the first ``most`` matching
    ones are followed instead.
    """
    rows = index_entries(documents).withColumn("score", score(now))
    newest = [F.desc_nulls_last("changed"), F.desc_nulls_last("dated"), F.desc_nulls_last("tail"), F.desc("at")]
    if hosts is None:
        rows = rows.select("*", F.lit(None).cast("int").alias("_most"))
    else:
        rule = hosts.select(F.col("host").alias("_host"), "pattern", F.col("most").alias("_most"))
        own = rows.withColumn("_host", host(F.col("url"))).join(rule, "_host", "left")
        rows = own.withColumn("_most", F.when(F.regexp("loc", F.col("pattern")), F.col("_most"))).drop("_host", "pattern")
    # of an address named twice in an index the best mention counts
    once = rows.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*of, "loc").orderBy(F.desc("score"), *newest))
    ).filter("_rn = 1").drop("_rn")
    group = W.partitionBy(*of)
    told = once.select("*", F.max("_most").over(group).alias("_rule"), F.max("score").over(group).alias("_best"))
    kept = told.filter(
        F.when(F.col("_rule").isNotNull(), F.col("_most").isNotNull()).when(F.col("_best") > 0, F.col("score") > 0).otherwise(True)
    )
    order = [
        F.when(F.col("_rule").isNull() & (F.col("_best") > 0), F.col("score")).desc_nulls_last(), F.desc_nulls_last("changed"),
        F.desc_nulls_last("dated"),
        F.when(F.col("_rule").isNull() & (F.col("_best") > 0), F.lit(None)).otherwise(F.col("tail")).desc_nulls_last(), F.desc("at")
    ]
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy(*of).orderBy(*order)))
    return ranked.filter(
        F.col("rank") <= F.least(F.lit(limit), F.coalesce("_rule", F.lit(limit)))
    ).select(*of, "loc", "score", "changed", "rank")


def expanded(
    roots: DataFrame, documents: DataFrame, now: Column, *, depth: int = DEPTH, limit: int = CHILDREN, hosts: DataFrame | None = None
) -> DataFrame:
    """roots: root, url. documents: url, body, one for each address. (root, url, depth) of the sitemaps and feeds that each root
    leads to through indexes, itself included if it is one; none twice for one root. depth: how many indexes deep."""
    is_index = F.col("body").rlike(r"(?i)<(?:[a-z0-9_.-]+:)?sitemapindex[\s>]")
    pages = documents.select("url", "body")
    frontier = roots.select("root", "url").distinct()
    visited, leaves = [], []
    for level in range(depth + 1):
        landed = stored(frontier.join(pages, "url").select("root", "url", "body", is_index.alias("_index")))
        leaves.append(landed.filter(~F.col("_index")).select("root", "url", F.lit(level).alias("depth")))
        visited.append(stored(frontier) if level == 0 else frontier)
        if level == depth:
            break
        named = children(landed.filter("_index").select("root", "url", "body"), now, of=["root", "url"], limit=limit, hosts=hosts)
        seen = reduce(DataFrame.unionByName, visited)
        frontier = stored(named.select("root", F.col("loc").alias("url")).distinct().join(seen, ["root", "url"], "left_anti"))
        if not frontier.limit(1).count():
            break
    return reduce(DataFrame.unionByName, leaves)
