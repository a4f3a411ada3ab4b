"""Deduplication and merging: batch dedupe, column-wise upsert, additive and greatest-value upserts, quarantine, retention.

Each is a pure function of DataFrames; ``merge_into`` puts the upsert on files, bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import blank_to
from ..functions.scalars import sanitized, truncated
from .stages import delete

NONE = "array<string>"


def quality_rank(c: Column) -> Column:
    """suspect below ok below recovered; anything else is ok."""
    return F.when(c == "suspect", 0).when(c == "recovered", 2).otherwise(1)


def united(*arrays: Column) -> Column:
    """Distinct members of all, in order; null and blank ones go."""
    whole = F.concat(*[F.coalesce(a, F.array().cast(NONE)) for a in arrays])
    # no blank text is as great as "!": lists of such members need no look at each, which is slow
    plain = F.sort_array(F.array_except(whole, F.array(F.lit(None).cast("string"))))
    looked = F.array_sort(F.array_distinct(F.filter(whole, lambda x: x.isNotNull() & (F.trim(x) != ""))))
    return F.when((F.size(whole) == 0) | (F.array_min(whole) >= "!"), plain).otherwise(looked)


def dedupe(
    rows: DataFrame, key: Column, *, arrays: tuple[str, ...] = ("feed_categories", "topics", "sections_normalized"),
    first: tuple[str, ...] = ("stable_id", "source_country")
) -> DataFrame:
    """One row per key: better title quality, then newer, then earlier in seq; lists united, gaps filled from the others.

    All is told by windows over one sort of each key's rows, so nearly all keys may be distinct: no group has an aggregate of objects.
    """
    order = [F.desc(quality_rank(F.col("title_quality"))), F.desc("publication_datetime"), F.asc("seq")]
    ranked = W.partitionBy(key).orderBy(*order)
    whole = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    told = {c: F.first(F.when(blank_to(c).isNotNull(), F.col(c)), True) for c in first} | {c: F.collect_set(c) for c in arrays}
    best = rows.select(
        "*", F.row_number().over(ranked).alias("_rn"), *[v.over(whole).alias(f"_of_{c}") for c, v in told.items()]
    ).filter("_rn = 1")
    return best.select(
        *[(united(F.flatten(f"_of_{c}")) if c in arrays else F.col(f"_of_{c}" if c in first else c)).alias(c) for c in rows.columns]
    )


def dedupe_batch(rows: DataFrame) -> DataFrame:
    """By feed id, or the article's id without one; then by the article's id."""
    return dedupe(dedupe(rows, F.coalesce("stable_id", "external_id")), F.col("external_id"))


def resolve_ids(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows with the id under which they are stored: a match by feed id goes before one by the article's id."""
    known = existing.filter("stable_id is not null").groupBy("stable_id").agg(F.min("external_id").alias("_known"))
    return rows.join(known, "stable_id", "left").withColumn(
        "external_id", F.coalesce("_known", "external_id")
    ).drop("_known").select(*rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows win, but: created_at stays, publication is at most the old created_at, a good title never gives way to a
    suspect one nor a real title to an address, lists are united, an empty snippet, feed id or publisher country keeps the old."""
    o, n = existing.alias("o"), incoming.alias("n")
    old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    both = o.join(n, F.col("o.external_id") == F.col("n.external_id"), "full")
    only_old, only_new = new("external_id").isNull(), old("external_id").isNull()
    good = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("ok"))
    keep_quality = good(old("title_quality")).isin("ok", "recovered") & (good(new("title_quality")) == "suspect")
    address = lambda r: (r("title_original") == r("url")) | r("title_original").like("http%")
    keep_title = keep_quality | F.coalesce(
        address(new) & old("title_original").isNotNull() & (old("title_original") != "") & ~address(old), F.lit(False)
    )
    rules = {
        "created_at": old("created_at"),
        "publication_datetime": F.least(new("publication_datetime"), old("created_at")),
        "stable_id": F.coalesce(new("stable_id"), old("stable_id")),
        "primary_section": F.coalesce(new("primary_section"), old("primary_section")),
        "primary_topic": F.coalesce(new("primary_topic"), old("primary_topic")),
        "source_country": F.coalesce(new("source_country"), old("source_country")),
        "title_original": F.when(keep_title, old("title_original")).otherwise(new("title_original")),
        "title_quality": F.when(keep_quality, old("title_quality")).otherwise(new("title_quality")),
        "sections_normalized": united(old("sections_normalized"), new("sections_normalized")),
        "topics": united(old("topics"), new("topics")),
        "feed_categories": F.array_sort(F.array_union(F.coalesce(old("feed_categories"), F.array().cast(NONE)), F.coalesce(new("feed_categories"), F.array().cast(NONE)))),
    }
    if "snippet_original" in incoming.columns:
        rules["snippet_original"] = F.coalesce(F.nullif(new("snippet_original"), F.lit("")), old("snippet_original"))
    return both.select(
        *[F.when(only_old, old(c)).when(only_new, new(c)).otherwise(rules.get(c, new(c))).alias(c) for c in incoming.columns]
    )


def upsert_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many rows an upsert inserts and updates."""
    keys = existing.select(F.col("external_id").alias("_key"))
    hit = incoming.select("external_id").join(keys, F.col("external_id") == F.col("_key"), "left")
    return hit.agg(F.count_if(F.col("_key").isNull()).alias("inserted"), F.count_if(F.col("_key").isNotNull()).alias("updated"))


def upsert_watermarks(existing: DataFrame, items: DataFrame) -> DataFrame:
    """The greatest publication per (outlet, method); null never wins."""
    new = items.groupBy("outlet_id", "method").agg(F.max("published_at").alias("last_publication_at"))
    return existing.select("outlet_id", "method", "last_publication_at").unionByName(new).groupBy("outlet_id", "method").agg(
        F.max("last_publication_at").alias("last_publication_at")
    )


def past_watermark(items: DataFrame, watermarks: DataFrame, oldest: Column) -> DataFrame:
    """Undated items, and those dated after both their endpoint's watermark and the oldest date allowed."""
    joined = items.join(watermarks, ["outlet_id", "method"], "left")
    return joined.filter(
        F.col("published_at").isNull() | (F.col("published_at") > F.greatest(F.coalesce("last_publication_at", oldest), oldest))
    ).drop("last_publication_at")


def add_rollup(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all counters by key."""
    counters = [c for c in new.columns if c not in keys]
    return existing.select(*new.columns).unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def quarantine(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Dateless candidates by id: how often seen, the longest snippet (of equally long ones the first in order)."""
    rows = existing.unionByName(candidates.withColumn("seen_count", F.lit(1).cast("long")).select(*existing.columns))
    return rows.groupBy("candidate_id").agg(
        F.sum("seen_count").alias("seen_count"),
        F.max_by("snippet", F.struct(F.length(F.coalesce("snippet", F.lit(""))), F.col("snippet"))).alias("snippet")
    )


def prefer_items(items: DataFrame) -> DataFrame:
    """One item per feed id or address: the newer, then the better score; lists united.

    Score, with fixed weights: share of title words in the address, its depth, a description's length, a real date and the title's quality.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 4))
    place = F.regexp_extract("link", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    title = words(F.col("title"))
    overlap = F.when(
        (F.size(title) > 0) & (F.size(words(place)) > 0),
        F.size(F.array_intersect(title, words(place))) / F.size(title) + F.least(
            F.size(F.filter(F.split(place, "/"), lambda x: x != "")), F.lit(6)
        ) * 0.01
    ).otherwise(0.0)
    score = overlap + F.least(
        F.length(F.coalesce("description", F.lit(""))), F.lit(400)
    ) / 10000 + F.when(F.col("fallback_date"), 0.0).otherwise(0.02) + quality_rank(F.col("title_quality")) * 0.05
    rank = F.struct(F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0)), F.round(score, 9), -F.col("seq"))
    rows = items.withColumn("_key", F.coalesce(blank_to("stable_id"), "link")).withColumn("_rank", rank)
    plain = [c for c in items.columns if c != "categories"]
    return rows.groupBy("_key").agg(
        *[F.max_by(F.struct(F.col(c)), "_rank")[c].alias(c) for c in plain],
        united(F.flatten(F.collect_set("categories"))).alias("categories")
    ).drop("_key")


def persistable(items: DataFrame, as_of: Column, days: int = 7, title: int = 400, snippet: int = 1200) -> DataFrame:
    """Items that may be stored: with an address, a title and a date, no older than so many days (0: of any age); texts without
    control characters and cut."""
    link = F.trim(sanitized(F.regexp_replace("link", "(?i)&amp;", "&")))
    rows = items.withColumns(
        {
            "link": link, "title": truncated(F.regexp_replace("title", r"\s+", " "), title),
            "description": F.nullif(truncated(F.regexp_replace("description", r"\s+", " "), snippet), F.lit(""))
        }
    )
    kept = rows.filter((F.col("link") != "") & (F.col("title") != "") & F.col("published_at").isNotNull())
    return kept.filter(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days))) if days > 0 else kept


def retained(rows: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    return rows.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite just the partitions that occur in rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def merge_into(incoming: DataFrame, path: str, buckets: int = 64) -> None:
    """Upsert into a table stored by bucket of the article's id: only buckets that occur in the batch are rewritten.

    The result is staged first, so a lost batch can be run again; the staged copy goes when the table is whole.
    """
    spark = incoming.sparkSession
    bucket = F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int")
    batch = dedupe_batch(incoming)
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        merged = batch
    else:
        # at most one for each bucket; ids come from the rows as they are, for which no duplicates need be found
        hit = [r[0] for r in incoming.select(bucket.alias("b")).distinct().collect()]
        merged = upsert(stored.filter(F.col("bucket").isin(hit)).select(*batch.columns), batch)
    staged = f"{path}.staged"
    merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(staged)
    replace_partitions(spark.read.parquet(staged), path, ["bucket"])
    delete([staged])
