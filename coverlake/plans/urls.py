"""Audit of addresses: rules for pages that are not articles, and how far a page's heading matches its title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import host, page_title, path
from .audit import title_tokens

#: (pattern of the host, pattern of the path), a table of our own; any rule that holds marks the address.
RULES = [(".", "^/(?:tag|author|category|login|search)(?:/|$)"), (r"^src1[0-9]*\.", "^/error/"), (".", "^/?$")]


def not_article(url: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    out = F.lit(False)
    for h, p in rules:
        out = out | (host(url).rlike(h) & path(url).rlike(p))
    return out


def flagged(articles: DataFrame) -> DataFrame:
    """Sources by how many of their addresses are no articles."""
    return articles.groupBy("source").agg(F.count_if(not_article(F.col("url"))).alias("not_articles"), F.count("*").alias("articles"))


def title_overlap(pages: DataFrame) -> DataFrame:
    """Shared words of title and first heading over max(3, min(words, 8))."""
    heading = F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", " ")
    rows = pages.select("page_id", title_tokens(page_title(F.col("html"))).alias("t"), title_tokens(heading).alias("h"))
    n = F.size("h")
    matches = F.size(F.array_intersect("t", "h"))
    return rows.select(
        "page_id", matches.cast("long").alias("matches"), F.round(matches / F.greatest(F.lit(3), F.least(n, F.lit(8))), 6).alias("overlap")
    )
