"""Sections, topics, places and publishers of articles by ordered rule tables, as Column expressions.

A rule table is a parameter: ordered (label, words). The first rule with a word in the text wins, so tables read top down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SECTIONS, blank_to
from ..functions.scalars import path

#: Confidence of each kind of evidence: keyword high, medium, none; category direct, high, medium, none.
KEYWORD = (0.84, 0.72, 0.51)
CATEGORY = (0.9, 0.86, 0.75, 0.55)
#: Weights of the sources of section candidates, and scores from which an unclassified article is recovered (others: .70).
WEIGHTS = {"page": 0.95, "stored": 0.85, "category": 0.55, "path": 0.35, "keyword": 0.2}
RECOVERY = {
    "politics": 0.7, "tech": 0.7, "business": 0.65, "conflicts": 0.65, "sports": 0.65, "health": 0.65, "entertainment": 0.65, "arts": 0.6,
    "lifestyle": 0.55
}

#: Small tables of our own, whose words occur in the fixtures.
HIGH = [("world", ["view"]), ("sports", ["click"]), ("business", ["purchase"])]
MEDIUM = [("tech", ["signup"]), ("science", ["error"])]
DIRECT = {"view": "world", "click": "sports", "k1": "tech", "k2": "health"}
TOPICS = [("desk one", ["k1", "k10", "k11"]), ("desk two", ["k2", "k20", "report"]), ("views", ["view", "report"])]
PLACES = [("North", ["k1", "k2", "k3"]), ("South", ["k4", "k5"]), ("East", ["k6"])]


def page_sections(pages: DataFrame, signals: DataFrame, source: str = "url", table: list | None = None) -> DataFrame:
    """The section of each page (page_id and the column of its context) by the first signal that a rule of the table knows, in
    the signals' order (page_id, rank, kind, place, signal); else by the words of its context; else others."""
    rules = table or HIGH + MEDIUM
    known = signals.withColumn("section", first_rule(F.lower("signal"), rules)).filter("section is not null")
    first = known.groupBy("page_id").agg(F.min_by(F.struct("section", "kind", "signal"), F.struct("rank", "place")).alias("_first"))
    context = first_rule(F.lower(F.coalesce(F.col(source), F.lit(""))), rules)
    rows = pages.select("page_id", context.alias("_context")).join(first, "page_id", "left")
    kind = F.when(F.col("_first").isNotNull(), F.col("_first.kind")).when(F.col("_context").isNotNull(), "context").otherwise("none")
    return rows.select(
        "page_id", F.coalesce("_first.section", "_context", F.lit("others")).alias("section"), kind.alias("kind"),
        F.col("_first.signal").alias("signal")
    )


def has_word(text: Column, words: list[str]) -> Column:
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])")


def first_rule(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    out: Column = F.lit(None).cast("string")
    for label, words in reversed(table):
        out = F.when(has_word(text, words), label).otherwise(out)
    return out


def keyword_section(text: Column, high: list = HIGH, medium: list = MEDIUM) -> Column:
    a, b = first_rule(text, high), first_rule(text, medium)
    return F.struct(
        F.coalesce(a, b, F.lit("others")).alias("section"),
        F.when(a.isNotNull(), KEYWORD[0]).when(b.isNotNull(), KEYWORD[1]).otherwise(KEYWORD[2]).alias("confidence")
    )


def category_section(categories: Column, direct: dict = DIRECT, high: list = HIGH, medium: list = MEDIUM) -> Column:
    """The first category that names a section; else by the words of all categories."""
    low = F.transform(categories, lambda c: F.lower(F.trim(c)))
    named = F.get(F.filter(low, lambda c: c.isin(*direct)), F.lit(0))
    label: Column = F.lit(None).cast("string")
    for name, section in direct.items():
        label = F.when(named == name, section).otherwise(label)
    text = F.array_join(low, " ")
    a, b = first_rule(text, high), first_rule(text, medium)
    score = F.when(label.isNotNull(), CATEGORY[0]).when(a.isNotNull(), CATEGORY[1]).when(b.isNotNull(), CATEGORY[2]).otherwise(CATEGORY[3])
    return F.struct(F.coalesce(label, a, b, F.lit("others")).alias("section"), score.alias("confidence"))


def title_text() -> Column:
    return F.lower(F.coalesce("title_original", F.lit("")))


def classify(articles: DataFrame) -> DataFrame:
    """Keyword and category evidence and the more confident of both; on a tie the keyword stays."""
    rows = articles.select("external_id", keyword_section(title_text()).alias("k"), category_section(F.col("feed_categories")).alias("c"))
    wins = F.col("c.confidence") > F.col("k.confidence")
    return rows.select(
        "external_id", F.col("k.section").alias("keyword_section"), F.col("c.section").alias("category_section"),
        F.when(wins, F.col("c.section")).otherwise(F.col("k.section")).alias("section"),
        F.greatest("k.confidence", "c.confidence").alias("confidence")
    )


def candidates(articles: DataFrame) -> DataFrame:
    """Section candidates of each article: weights of all evidence summed and capped at 1, best first, then in section order."""
    found = classify(articles).select("external_id", "keyword_section", "category_section")
    rows = articles.select(
        "external_id", blank_to("primary_section").alias("stored"),
        F.lower(F.regexp_extract(path(F.col("url")), "^/([^/]+)", 1)).alias("part")
    ).join(found, "external_id")
    by_path = F.lit(None).cast("string")
    for name, section in DIRECT.items():
        by_path = F.when(F.col("part") == name, section).otherwise(by_path)
    evidence = [
        ("stored", F.col("stored")), ("category", F.col("category_section")), ("path", by_path), ("keyword", F.col("keyword_section"))
    ]
    each = rows.select(
        "external_id",
        F.explode(
            F.array(*[F.struct(label.alias("label"), F.lit(int(100 * WEIGHTS[name])).alias("w")) for name, label in evidence])
        ).alias("e")
    ).filter(F.col("e.label").isNotNull() & (F.col("e.label") != "others"))
    return each.groupBy("external_id", F.col("e.label").alias("label")).agg((F.least(F.sum("e.w"), F.lit(100)) / 100).alias("score"))


def primary_section(articles: DataFrame) -> DataFrame:
    """The stored section, or for unclassified articles the first candidate that reaches its recovery score."""
    need: Column = F.lit(0.7)
    for section, score in RECOVERY.items():
        need = F.when(F.col("label") == section, score).otherwise(need)
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("label"))
    good = candidates(articles).filter(F.col("score") >= need).groupBy("external_id").agg(
        F.min_by("label", F.struct(-F.col("score"), place)).alias("recovered")
    )
    stored = F.coalesce(blank_to("primary_section"), blank_to("section"), F.lit("others"))
    return articles.select("external_id", stored.alias("stored")).join(good, "external_id", "left").select(
        "external_id",
        F.when(F.col("stored") == "others", F.coalesce("recovered", F.lit("others"))).otherwise(F.col("stored")).alias("section")
    )


def topic_scores(articles: DataFrame, table: list = TOPICS) -> DataFrame:
    """Topics of each title: 0.6 for one word of the topic and 0.15 for each more, at most 1."""
    matches = [
        F.struct(F.lit(topic).alias("topic"), sum((has_word(title_text(), [w]).cast("int") for w in words), F.lit(0)).alias("n"))
        for topic, words in table
    ]
    rows = articles.select("external_id", F.explode(F.array(*matches)).alias("m")).filter("m.n > 0")
    return rows.select(
        "external_id", "m.topic", F.least(F.lit(100), F.lit(60) + 15 * (F.col("m.n") - 1)).cast("long").alias("score_percent")
    )


def places(articles: DataFrame, table: list = PLACES) -> DataFrame:
    """The place a title names, else the publisher's country."""
    named = first_rule(title_text(), table)
    return articles.select(
        "external_id", F.coalesce(named, blank_to("source_country"), F.lit("Global")).alias("place"),
        F.when(named.isNotNull(), "title").when(blank_to("source_country").isNotNull(), "publisher").otherwise("none").alias("basis")
    )


def publisher_match(articles: DataFrame, rules: list[tuple[str, list[str], list[str], list[str]]]) -> DataFrame:
    """rules: (name, exact, prefixes, parts), first rule first; in a rule exact is high, prefix medium, part low confidence."""
    low = F.lower(F.col("source"))
    name: Column = F.col("source")
    confidence: Column = F.lit("low")
    for publisher, exact, prefixes, parts in reversed(rules):
        same = low.isin(exact) if exact else F.lit(False)
        begins = low.rlike("^(?:" + "|".join(prefixes) + ")") if prefixes else F.lit(False)
        within = low.rlike("|".join(parts)) if parts else F.lit(False)
        name = F.when(same | begins | within, publisher).otherwise(name)
        confidence = F.when(same, "high").when(begins, "medium").when(within, "low").otherwise(confidence)
    return articles.select("source").distinct().select("source", name.alias("publisher"), confidence.alias("confidence"))


PUBLISHERS = [("First Group", ["src1"], ["src2"], []), ("Second Group", ["src3", "src4"], [], ["9"])]


def endpoint_classes(runs: DataFrame) -> DataFrame:
    """Endpoints of each country by class: feeds, news and other sitemaps, by their addresses."""
    kind = F.when(F.col("method") == "rss", "rss").when(
        F.col("requested_url").rlike("/0$"), "news_sitemap"
    ).when(F.col("requested_url").rlike("/1$"), "index").otherwise("sitemap")
    ends = runs.select("country", "requested_url", kind.alias("kind")).distinct()
    return ends.groupBy("country").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("rss", "news_sitemap", "index", "sitemap")])


def freshness(runs: DataFrame, as_of: Column, fresh_hours: int = 24, stale_hours: int = 96) -> DataFrame:
    """State of each source by the age of its last success."""
    last = runs.filter(F.col("ok") & F.col("attempted") & (F.col("ran_at") <= as_of)).groupBy("source").agg(F.max("ran_at").alias("last"))
    age = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 3600
    state = F.when(age <= fresh_hours, "fresh").when(age <= stale_hours, "aging").otherwise("stale")
    return last.select("source", state.alias("state"), "last")
