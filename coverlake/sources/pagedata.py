"""What pages tell of themselves in JSON-LD, by Variant: all scripts, lists of objects, and ``@graph``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feeds import LD

# Names of metadata that tell a section or keywords.
SECTION_NAMES = ("article:section", "article:section2", "articlesection", "og:section", "section")
KEYWORD_NAMES = ("article:tag", "news_keywords", "keywords")
#: How many objects deep a list of objects is followed.
DEPTH = 3
TEXT = "string"


def unescaped(c: Column) -> Column:
    for name, mark in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def objects(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, script, place, object): all objects that the scripts of a page hold at the top, in lists, or in ``@graph``."""
    scripts = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit(LD), F.lit(1))).alias("script", "_t"))
    # a text that does not parse is slow to fail: it is tried again only if there is something to unescape
    again = F.when(F.contains("_t", F.lit("&")), F.try_parse_json(unescaped(F.col("_t"))))
    whole = scripts.select(key, "script", F.coalesce(F.try_parse_json("_t"), again).alias("_v")).filter("_v is not null")
    level = whole.select(key, "script", F.array(F.lit(0)).alias("place"), F.col("_v").alias("object"), F.lit(False).alias("_open"))
    many = lambda path: F.try_variant_get("object", path, "array<variant>")
    one = lambda x, done: F.struct(x.alias("object"), F.lit(done).alias("_open"))
    inside = lambda path: F.transform(many(path), lambda x: one(x, False))
    itself = F.array(one(F.col("object"), True))
    for _ in range(DEPTH):
        told = F.when(F.col("_open"), itself).when(many("$").isNotNull(), inside("$")).when(
            many("$['@graph']").isNotNull(), F.concat(itself, inside("$['@graph']"))
        ).otherwise(itself)
        level = level.select(key, "script", "place", F.posexplode(told).alias("_k", "_o")).select(
            key, "script", F.array_append("place", F.col("_k")).alias("place"), "_o.object", "_o._open"
        )
    return level.filter(many("$").isNull()).select(key, "script", "place", "object")


def listed(v: Column) -> Column:
    """Texts of a value that is one text or a list of them."""
    none = F.array().cast("array<string>")
    many = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda x: F.coalesce(F.try_variant_get(x, "$", TEXT), F.try_variant_get(x, "$.name", TEXT))
    )
    return F.coalesce(many, F.filter(F.array(F.try_variant_get(v, "$", TEXT)), lambda x: x.isNotNull()), none)


def crumbs(v: Column) -> Column:
    """Names of a breadcrumb's entries."""
    entries = F.coalesce(F.try_variant_get(v, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    name = lambda e: F.coalesce(
        F.try_variant_get(e, "$.name", TEXT), F.try_variant_get(e, "$.item.name", TEXT), F.try_variant_get(e, "$.item", TEXT)
    )
    return F.filter(F.transform(entries, name), lambda x: x.isNotNull())


def metadata(html: Column, names: tuple[str, ...]) -> Column:
    """Contents of meta elements with such a name, in page order, whichever attribute comes first."""
    elements = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    name = lambda e: F.lower(F.regexp_extract(e, r"""(?is)\s(?:property|name|itemprop)\s*=\s*["']([^"']*)["']""", 1))
    own = F.filter(elements, lambda e: name(e).isin(*names))
    content = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.transform(own, lambda e: unescaped(F.concat(F.regexp_extract(e, content, 1), F.regexp_extract(e, content, 2))))


def signals(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, rank, kind, place, signal): what a page says of its section, in the order in which it counts: metadata, the
    article's section, breadcrumbs, keywords. Blank ones go."""
    o = F.col("object")
    at = lambda path: F.try_variant_get(o, path, "variant")
    kinds = F.transform(listed(at("$['@type']")), F.lower)
    none = F.array().cast("array<string>")
    own = F.when(F.array_contains(kinds, "breadcrumblist"), crumbs(o)).otherwise(none)
    words = F.flatten(F.transform(listed(at("$.keywords")), lambda x: F.split(x, r"\s*[,;]\s*")))
    told = objects(pages, key, html).select(key, F.col("script"), F.col("place"), F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("article_section").alias("kind"), listed(at("$.articleSection")).alias("values")),
        F.struct(F.lit(2).alias("rank"), F.lit("breadcrumb").alias("kind"), F.concat(F.coalesce(crumbs(at("$.breadcrumb")), none), own).alias("values")),
        F.struct(F.lit(3).alias("rank"), F.lit("keywords").alias("kind"), words.alias("values")),
    )).alias("k")).select(key, "k.rank", "k.kind", F.array_prepend("place", F.col("script")).alias("place"), "k.values")
    page = F.col(html)
    metas = pages.select(F.col(key), F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("meta").alias("kind"), metadata(page, SECTION_NAMES).alias("values")),
        F.struct(F.lit(3).alias("rank"), F.lit("keywords").alias("kind"), F.flatten(F.transform(metadata(page, KEYWORD_NAMES), lambda x: F.split(x, r"\s*[,;]\s*"))).alias("values")),
    )).alias("k")).select(key, "k.rank", "k.kind", F.array(F.lit(-1)).alias("place"), "k.values")
    each = metas.unionByName(told).select(key, "rank", "kind", "place", F.posexplode("values").alias("_k", "signal"))
    clean = F.trim(F.regexp_replace("signal", r"\s+", " "))
    return each.select(
        key, "rank", "kind", F.array_append("place", F.col("_k")).alias("place"), clean.alias("signal")
    ).filter("signal <> ''")
