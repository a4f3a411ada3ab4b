"""Audits and search: news search with filters and paging, filter values, taxonomy, topics, addresses and categories."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, percent, visible
from ..functions.scalars import host
from ..operators.relational import latest, top_k


@dataclass(frozen=True)
class NewsQuery:
    """Options of a news search; bounds are clamped, blank list entries go."""

    text: str = ""
    sections: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    hours: int | None = None
    start: str | None = None
    end: str | None = None
    limit: int = 50
    offset: int = 0

    def filters(self, as_of: str) -> list[Column]:
        claimed = F.least("publication_datetime", "created_at")
        out = [visible(), F.col("created_at") <= at(as_of)]
        if self.hours is not None:
            out.append(claimed > before(as_of, f"{min(max(self.hours, 1), 720)} hours"))
        if self.start:
            out.append(claimed >= at(self.start))
        if self.end:
            out.append(claimed <= at(self.end))
        for column, values in (("source", self.sources), ("source_country", self.countries)):
            if kept := listed(values):
                out.append(F.col(column).isin(kept))
        if kept := listed(self.sections):
            wanted = F.array(*[F.lit(x) for x in kept])
            bare = F.size(F.coalesce("sections_normalized", F.array().cast("array<string>"))) == 0
            out.append(F.arrays_overlap("sections_normalized", wanted) | bare & blank_to("section", "others").isin(kept))
        if kept := listed(self.topics):
            out.append(F.arrays_overlap("topics", F.array(*[F.lit(x) for x in kept])))
        if q := self.text.strip()[:120].replace("\\", "\\\\"):  # % and _ are wild cards, a backslash is none
            fields = [F.coalesce("title_original", F.lit("")), F.col("source"), F.array_join("feed_categories", " ")]
            out.append(reduce(lambda a, b: a | b, [c.ilike(f"%{q}%") for c in fields]))
        return out


def listed(values: list[str]) -> list[str]:
    return list(dict.fromkeys(x.strip() for v in values for x in v.split(",") if x.strip()))


def search(articles: DataFrame, query: NewsQuery, as_of: str) -> DataFrame:
    """One page, newest first, with the total and whether there is more."""
    size = min(max(query.limit, 1), 200)
    rows = articles.filter(reduce(and_, query.filters(as_of)))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("publication_datetime"), F.asc("external_id")).offset(query.offset).limit(size)
    shown = page.select(
        "external_id", "title_original", "source", blank_to("source_country").alias("source_country"),
        blank_to("section", "others").alias("section"), "publication_datetime", F.array_join("topics", ",").alias("topics")
    )
    return shown.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > query.offset + size)


def search_estimated(articles: DataFrame, query: NewsQuery, as_of: str) -> DataFrame:
    """One page as of search(), without counting all: one more row than asked for tells whether there is more, and the total is
    what the page has shown so far, and one if there is more."""
    size = min(max(query.limit, 1), 200)
    rows = articles.filter(reduce(and_, query.filters(as_of)))
    shown = rows.select(
        "external_id", "title_original", "source", "publication_datetime"
    ).orderBy(F.desc("publication_datetime"), F.asc("external_id")).offset(query.offset).limit(size + 1)
    seen = F.count("*")
    totals = shown.agg(
        (F.least(seen, F.lit(size)) + query.offset + F.when(seen > size, 1).otherwise(0)).alias("total"), (seen > size).alias("has_more")
    )
    page = shown.orderBy(F.desc("publication_datetime"), F.asc("external_id")).limit(size)
    return page.crossJoin(F.broadcast(totals)).withColumn("total_is_estimate", F.lit(True))


def after(articles: DataFrame, created_at: str, external_id: str, k: int) -> DataFrame:
    """Keyset paging: the k rows that come after a known last one, newest first."""
    key = F.struct(F.col("created_at"), F.col("external_id"))
    rows = articles.filter(key < F.struct(at(created_at), F.lit(external_id)))
    return rows.orderBy(F.desc("created_at"), F.desc("external_id")).limit(k).select("external_id", "created_at", "source")


def filter_values(articles: DataFrame) -> DataFrame:
    """Distinct values of each filter: one pass over (kind, value) pairs."""
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), v.alias("value"))
            for k, v in (("country", blank_to("source_country")), ("source", blank_to("source")), ("section", blank_to("section")))
        ]
    )
    return articles.filter(visible()).select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()


def taxonomy_by_source(articles: DataFrame, as_of: str, hours: int = 720, least: int = 5) -> DataFrame:
    """How much of each source is unclassified."""
    rows = articles.filter((F.col("created_at") >= before(as_of, f"{hours} hours")) & (F.col("created_at") <= at(as_of)))
    others = F.count_if(blank_to("section", "others") == "others")
    return rows.groupBy("source").agg(
        F.count("*").alias("articles"), others.alias("others"), F.count_if(F.size("feed_categories") == 0).alias("without_categories"),
        F.count_if(blank_to("primary_topic").isNull()).alias("without_topic")
    ).filter(F.col("articles") >= least).withColumn("others_percent", percent(F.col("others"), F.col("articles")))


def taxonomy_totals(articles: DataFrame, as_of: str, hours: int = 720) -> DataFrame:
    rows = articles.filter((F.col("created_at") >= before(as_of, f"{hours} hours")) & (F.col("created_at") <= at(as_of)))
    n = F.count("*")
    return rows.agg(
        n.alias("articles"), percent(F.count_if(blank_to("section", "others") == "others"), n).alias("others_percent"),
        percent(F.count_if(F.size("feed_categories") > 0), n).alias("categories_percent"),
        percent(F.count_if(blank_to("primary_topic").isNotNull()), n).alias("topic_percent")
    )


def category_sections(articles: DataFrame, as_of: str, hours: int = 720, k: int = 3) -> DataFrame:
    """For each feed category the sections it meets, most frequent first, as one text."""
    each = articles.filter((F.col("created_at") >= before(as_of, f"{hours} hours")) & (F.col("created_at") <= at(as_of))).select(
        blank_to("section", "others").alias("section"), F.explode("feed_categories").alias("category")
    )
    ranked = top_k(each.groupBy("category", "section").agg(F.count("*").alias("n")), ["category"], k, F.desc("n"), F.asc("section"))
    return ranked.groupBy("category").agg(
        F.sum("n").alias("articles"),
        F.expr("listagg(concat(section, ':', cast(n as string)), ', ') within group (order by rn)").alias("sections")
    )


def others_by_source(articles: DataFrame, as_of: str, days: int = 30, k: int = 3) -> DataFrame:
    """Sources of unclassified articles with sample titles and the likeliest section by score, from JSON candidates."""
    rows = articles.filter(
        (blank_to("section", "others") == "others") & (F.col("created_at") >= before(as_of, f"{days} days"))
        & (F.col("created_at") <= at(as_of))
    )
    best = rows.select(
        "source",
        F.expr(
            "array_sort(from_json(candidates, 'array<struct<label:string,score:double>>'), (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.label < b.label then -1 when a.label > b.label then 1 else 0 end)[0].label"
        ).alias("label")
    )
    counts = best.groupBy("source", F.coalesce("label", F.lit("(none)")).alias("label")).agg(F.count("*").alias("n"))
    return top_k(counts, ["source"], k, F.desc("n"), F.asc("label")).withColumn("rn", F.col("rn").cast("long"))


def candidates() -> Column:
    """JSON candidates as the classifier stores them, here from the article's counters."""
    one = lambda label, score: F.struct(F.lit(label).alias("label"), score.alias("score"))
    k = F.col("k")
    return F.to_json(F.array(one("world", (k % 7) / 10.0), one("tech", (k % 5) / 10.0), one("sports", (k % 3) / 10.0)))


def topic_audit(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Articles by topic; those with none stay, as (empty)."""
    rows = articles.filter((F.col("created_at") >= before(as_of, f"{days} days")) & (F.col("created_at") <= at(as_of)))
    return rows.select("source", F.explode_outer("topics").alias("t")).groupBy(F.coalesce(blank_to("t"), F.lit("(empty)")).alias("topic")).agg(
        F.count("*").alias("articles"), F.countDistinct("source").alias("sources")
    )


def url_sample(articles: DataFrame, as_of: str, hours: int = 240) -> DataFrame:
    """The newest address of each source."""
    rows = articles.filter((F.col("created_at") >= before(as_of, f"{hours} hours")) & (F.col("created_at") <= at(as_of)))
    return latest(rows, ["source"], F.desc("created_at"), F.desc("external_id")).select("source", "external_id", "url")


def title_tokens(c: Column) -> Column:
    """Words of four or more, in order."""
    return F.array_sort(
        F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 4))
    )


def url_date(url: Column | str) -> Column:
    """The date in the path, /yyyy/mm/dd; null without one."""
    return F.nullif(
        F.regexp_replace(
            F.regexp_extract(
                url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*?/(20[0-9]{2}/(?:0[1-9]|1[0-2])/(?:[0-2][0-9]|3[01]))(?=/|[?#]|$)", 1
            ),
            "/", "-"
        ),
        F.lit("")
    )


def similar_titles(rows: DataFrame, least_overlap: int, containment: float, jaccard: float) -> DataFrame:
    """rows: host, tokens, legacy. (host, tokens, other_tokens) with overlap, containment and jaccard: pairs of like token sets of
    one host, the first of legacy rows, the other of canonical ones.

    Two sets that have to share m of their n tokens (the least overlap, or ceil(t * n) for a Jaccard similarity of t) share one among
    the first n - m + 1 of each, rarest first; so sets meet by host and rare token instead of in all pairs of a host. Those that
    share several such tokens count at the first, which both have in the same order: no pair is held to be found again.
    """
    rows = rows.filter(F.size("tokens") >= least_overlap)
    each = rows.select("host", "tokens", "legacy").distinct().select("host", "tokens", "legacy", F.explode("tokens").alias("token"))
    # a word of a large host is counted in parts, not sorted in one place
    counted = each.join(each.groupBy("host", "token").agg(F.count("*").alias("_n")), ["host", "token"])
    ordered = counted.groupBy("host", "tokens", "legacy").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "token"))), lambda x: x["token"]).alias("_rare")
    )
    n = F.size("_rare")
    keys = F.slice("_rare", 1, n - F.greatest(F.ceil(n * jaccard).cast("int"), F.lit(least_overlap)) + 1)
    keyed = ordered.select("host", "tokens", "legacy", keys.alias("_keys")).select("*", F.explode("_keys").alias("token"))
    old, new = keyed.filter("legacy").drop("legacy"), keyed.filter("not legacy").select(
        "host", "token", F.col("tokens").alias("other_tokens"), F.col("_keys").alias("_others")
    )
    once = F.get(F.array_intersect("_keys", "_others"), F.lit(0)) == F.col("token")
    pairs = old.join(new, ["host", "token"]).filter(once).select("host", "tokens", "other_tokens")
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    smaller, union = F.least(F.size("tokens"), F.size("other_tokens")), F.size("tokens") + F.size("other_tokens") - F.col("overlap")
    scored = pairs.withColumn("overlap", shared).withColumn(
        "containment", F.round(F.col("overlap") / smaller, 6)
    ).withColumn("jaccard", F.round(F.col("overlap") / union, 6))
    return scored.filter((F.col("overlap") >= least_overlap) & (F.col("containment") >= containment) & (F.col("jaccard") >= jaccard))


def url_drift(
    articles: DataFrame, hours: int = 36, least_overlap: int = 4, containment: float = 0.6, jaccard: float = 0.5, source_prefix: str = ""
) -> DataFrame:
    """For each article without a feed id the best one of its host with one: a like title, published within a band of time,
    and on one date if the addresses of both tell one. Best by containment, then Jaccard similarity, then the gap in time.

    Titles are compared as distinct token sets of a host, never as articles. For each pair of sets an article then finds the
    nearest publication before and after its own by windows over both sides in order of time, so articles of one repeated title
    do not meet in pairs. A window holds the articles of a span of time as long as the band, and what is offered in that span and
    those beside it, so all of one title are never in one place. Of equally near ones the first by id counts.
    """
    told = articles.filter(F.col("source").startswith(source_prefix)).select(
        "external_id", F.col("stable_id").isNull().alias("legacy"), F.lower(host(F.col("url"))).alias("host"), url_date("url").alias("day"), title_tokens(F.col("title_original")).alias("tokens"), F.unix_seconds(F.col("publication_datetime").cast("timestamp")).alias("at"),
    )
    rows = told.filter((F.size("tokens") >= least_overlap) & (F.col("host") != "") & F.col("at").isNotNull())
    pairs = similar_titles(rows, least_overlap, containment, jaccard)
    # an address without a date meets all; one with a date meets that date's and those without
    any_day, no_day = F.lit("any"), F.lit("none")
    ask = F.when(F.col("day").isNull(), F.array(any_day)).otherwise(F.array("day", no_day))
    left = rows.filter("legacy").join(pairs, ["host", "tokens"]).select(
        "host", "other_tokens", F.explode(ask).alias("day"), "at", "external_id", "overlap", "containment", "jaccard",
        F.lit(None).cast("string").alias("found")
    )
    offers = rows.filter("not legacy").select(
        "host", F.col("tokens").alias("other_tokens"), F.explode(F.array(any_day, F.coalesce("day", no_day))).alias("day"), "at",
        "external_id"
    )
    offered = offers.groupBy("host", "other_tokens", "day", "at").agg(F.min("external_id").alias("found"))
    none = {c: F.lit(None).cast(t) for c, t in left.dtypes if c in ("external_id", "overlap", "containment", "jaccard")}
    span = F.floor(F.col("at") / max(hours * 3600, 1))
    # an offer is there once for its set and time, an article for each like set: so offers are the side to repeat
    both = left.withColumn("span", span).unionByName(
        offered.withColumns(none).withColumn("span", F.explode(F.sequence(span - 1, span + 1)))
    )
    group = W.partitionBy("host", "other_tokens", "day", "span")
    order, reverse = group.orderBy("at", F.col("found").isNull()), group.orderBy(F.desc("at"), F.col("found").isNull())
    candidate = F.when(F.col("found").isNotNull(), F.struct("at", "found"))
    near = both.withColumn("_before", F.last(candidate, True).over(order)).withColumn(
        "_after", F.last(candidate, True).over(reverse)
    ).filter("external_id is not null")
    each = near.select(
        "external_id", "at", "overlap", "containment", "jaccard", F.explode(F.array("_before", "_after")).alias("c")
    ).filter("c is not null")
    gaps = each.withColumn("gap", F.abs(F.col("at") - F.col("c.at"))).filter(F.col("gap") <= hours * 3600)
    best = latest(gaps, ["external_id"], F.desc("containment"), F.desc("jaccard"), F.asc("gap"), F.asc("c.found"))
    return best.select(
        "external_id", F.col("c.found").alias("other_id"), F.col("overlap").cast("long").alias("overlap"), "containment", "jaccard", "gap"
    )


def category_prediction(articles: DataFrame, least_support: int = 3, least_share: float = 0.4) -> DataFrame:
    """Categories that a path segment predicts: share of the segment's articles with the category."""
    tokens = F.array_distinct(
        F.filter(F.split(F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1), "/"), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$"))
    )
    rows = articles.select("external_id", tokens.alias("tokens"), "feed_categories")
    by_token = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("articles"))
    both = rows.select(F.explode("tokens").alias("token"), "feed_categories").select(
        "token", F.explode("feed_categories").alias("category")
    ).groupBy("token", "category").agg(F.count("*").alias("support"))
    share = F.round(F.col("support") / F.col("articles"), 6)
    return both.join(by_token, "token").withColumn("share", share).filter(
        (F.col("support") >= least_support) & (F.col("share") >= least_share)
    )


def country_stats(articles: DataFrame, as_of: str) -> DataFrame:
    day = before(as_of, "24 hours")
    return articles.groupBy(blank_to("country", "Global").alias("country")).agg(
        F.count("*").alias("total"), F.count_if((F.col("created_at") >= day) & (F.col("created_at") <= at(as_of))).alias("last_24h"),
        F.max("publication_datetime").alias("newest")
    )


def country_report(articles: DataFrame, catalog: DataFrame, as_of: str) -> DataFrame:
    """Publisher country against article country, with the catalog's countries zero-filled."""
    day = before(as_of, "24 hours")
    recent = (F.col("created_at") >= day) & (F.col("created_at") <= at(as_of))
    rows = articles.join(
        catalog.select("catalog_source", "catalog_country", "distribution_class"), F.col("source") == F.col("catalog_source"), "left"
    )
    core = F.coalesce("distribution_class", F.lit("publisher")) != "portal"
    by_publisher = rows.groupBy(F.coalesce("catalog_country", blank_to("source_country"), F.lit("Global")).alias("country")).agg(
        F.count_if(recent & core).alias("core_inserted"), F.count_if(recent & ~core).alias("portal_inserted"),
        F.count_if(recent & (F.col("publication_datetime") < day)).alias("late")
    )
    by_place = rows.groupBy(blank_to("country", "Global").alias("country")).agg(F.count_if(recent).alias("covered"))
    places = catalog.select(F.col("catalog_country").alias("country")).distinct()
    joined = by_publisher.join(by_place, "country", "full").join(places, "country", "full").na.fill(0)
    inserted = F.col("core_inserted") + F.col("portal_inserted")
    return joined.withColumn("late_share", F.when(inserted > 0, F.round(F.col("late") / inserted, 6)).otherwise(0.0))


def mention_summary(articles: DataFrame, mentions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Articles that any mention names, by entity type, with their sources in order."""
    rows = articles.filter(
        visible() & (F.col("created_at") >= before(as_of, f"{days} days")) & (F.col("created_at") <= at(as_of))
    ).select("external_id", "source", "section")
    edges = mentions.select("article_external_id", "entity_type").distinct()
    joined = rows.join(edges, rows["external_id"] == edges["article_external_id"])
    return joined.groupBy("entity_type").agg(
        F.count("*").alias("articles"), F.countDistinct("source").alias("sources"),
        F.countDistinct(F.when(blank_to("section", "others") == "world", F.col("source"))).alias("world_sources"),
        F.bool_or(F.col("section") == "sports").alias("any_sports"),
        F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 5), ",").alias("first_sources")
    )


def mention_lane(articles: DataFrame, mentions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """How many visible articles any mention names."""
    rows = articles.filter(visible() & (F.col("created_at") >= before(as_of, f"{days} days")) & (F.col("created_at") <= at(as_of)))
    named = rows.join(mentions, rows["external_id"] == mentions["article_external_id"], "left_semi")
    return rows.agg(F.count("*").alias("articles")).crossJoin(F.broadcast(named.agg(F.count("*").alias("named"))))


def latest_snapshots(orders: DataFrame) -> DataFrame:
    """The newest snapshot of each account: its order with the latest date, then the largest key."""
    rows = latest(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def roster(customers: DataFrame, orders: DataFrame, k: int = 2) -> DataFrame:
    """Every account with its first k snapshots by price; accounts without any stay."""
    ranked = top_k(orders, ["o_custkey"], k, F.desc("o_totalprice"), F.asc("o_orderkey"))
    return customers.join(ranked, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_mktsegment", F.col("rn").cast("long").alias("rn"), "o_orderkey", "o_totalprice"
    )


def title_lift(articles: DataFrame, as_of: str, days: int = 5) -> DataFrame:
    """Titles of each source that no source had before, against all of its titles."""
    title = F.lower(blank_to("title_original"))
    split = before(as_of, f"{days} days")
    rows = articles.filter(F.col("created_at") <= at(as_of)).select(
        "source", title.alias("title"), (F.col("created_at") >= split).alias("new")
    ).filter("title is not null")
    new, old = rows.filter("new").select("source", "title").distinct(), rows.filter("not new").select("title").distinct()
    fresh = new.join(old, "title", "left_anti").groupBy("source").agg(F.count("*").alias("new_titles"))
    return new.groupBy("source").agg(F.count("*").alias("titles")).join(fresh, "source", "left").na.fill(0, ["new_titles"])


def per_hour(articles: DataFrame) -> DataFrame:
    """Articles by hour with a running total within the day."""
    hours = articles.groupBy(
        F.to_date("created_at").alias("day"), F.hour("created_at").cast("long").alias("hour")
    ).agg(F.count("*").alias("articles"))
    return hours.withColumn("running", F.sum("articles").over(W.partitionBy("day").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)))
