"""Country benchmark: hourly and daily snapshots of publishing volume, freshness, lateness and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, low_signal, within
from ..operators.relational import concentration

UNKNOWN = "(unknown)"


def effective() -> Column:
    """Publication counts at the latest when the article was first seen."""
    return F.least("publication_datetime", "created_at")


def source_counts(articles: DataFrame, start: Column, end: Column, hour: Column | None = None) -> DataFrame:
    """Counts of each (country, source) in [start, end). An article counts if either clock is in the window; that filter
    reaches the scan, and holds all rows that any count needs."""
    rows = articles.filter((within("created_at", start, end) | within("publication_datetime", start, end)) & ~low_signal())
    seen, claimed = within("created_at", start, end), within(effective(), start, end)
    counts = [
        F.count_if(seen).alias("inserted"), F.count_if(claimed).alias("published"), F.count_if(seen & claimed).alias("fresh"),
        F.count_if(seen & (effective() < start)).alias("late")
    ]
    if hour is not None:
        counts.append(F.count_if(within("created_at", hour, end)).alias("inserted_1h"))
    return rows.groupBy(blank_to("source_country").alias("source_country"), "source").agg(*counts)


def spelled(c: Column | str) -> Column:
    """Lower case, single spaces: under which names meet that are spelled differently."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def resolve_country(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (source_country, source) with country: the row's own in the catalog's spelling; without one the catalog's for the
    source by its exact name, then by its name in any spelling; else unknown. Of several the first in order."""
    names = catalog.groupBy(spelled("catalog_country").alias("_spelled")).agg(F.min("catalog_country").alias("_canonical"))
    exact = catalog.groupBy(F.trim("catalog_source").alias("_exact")).agg(F.min("catalog_country").alias("_by_name"))
    loose = catalog.groupBy(spelled("catalog_source").alias("_loose")).agg(F.min("catalog_country").alias("_by_spelling"))
    own = rows.join(names, spelled("source_country") == F.col("_spelled"), "left")
    found = own.join(exact, F.trim("source") == F.col("_exact"), "left").join(loose, spelled("source") == F.col("_loose"), "left")
    country = F.coalesce("_canonical", blank_to(F.trim("source_country")), "_by_name", "_by_spelling", F.lit(UNKNOWN))
    return found.withColumn("country", country).drop("_spelled", "_canonical", "_exact", "_by_name", "_loose", "_by_spelling")


def with_country(counts: DataFrame, catalog: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums by country and source."""
    sums = [c for c in counts.columns if c not in ("source_country", "source", *keys)]
    return resolve_country(counts, catalog).groupBy(*keys, "country", "source").agg(*[F.sum(c).alias(c) for c in sums])


def by_country(rows: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Totals of each country, with the shares of its largest sources by what they published: one pass over the sources."""
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "source")]
    active = F.count_if((F.col("published") > 0) | (F.col("inserted") > 0)).alias("active_sources")
    return concentration(rows, list(keys), "source", "published", also=(*sums, active))


def hourly(articles: DataFrame, catalog: DataFrame, as_of: str, version: str = "v1") -> DataFrame:
    """The last 24 hours up to as_of itself; only the bucket's name is the whole hour."""
    rows = with_country(source_counts(articles, before(as_of, "24 hours"), at(as_of), before(as_of, "1 hour")), catalog)
    return by_country(rows).select(
        F.date_trunc("hour", at(as_of)).cast("timestamp_ntz").alias("hour_bucket"), F.lit(version).alias("metric_version"), "*"
    )


def daily_sources(articles: DataFrame, catalog: DataFrame, day: str, days: int = 1) -> DataFrame:
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    return with_country(source_counts(articles, start, start + F.expr(f"interval {days} days")), catalog)


def daily(articles: DataFrame, catalog: DataFrame, day: str, version: str = "v1", days: int = 1) -> DataFrame:
    return by_country(daily_sources(articles, catalog, day, days)).select(
        F.lit(day).cast("date").alias("day_bucket"), F.lit(version).alias("metric_version"), "*"
    )


def daily_series(articles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Snapshots of all days at once: each article goes to the day it was seen and the day it was published, if another."""
    seen, claimed = F.to_date("created_at"), F.to_date(effective())
    rows = articles.filter(~low_signal()).select(
        blank_to("source_country").alias("source_country"), "source", seen.alias("_seen"), claimed.alias("_claimed")
    )
    each = rows.select("*", F.explode(F.array_distinct(F.array("_seen", "_claimed"))).alias("day_bucket"))
    is_seen, is_claimed = F.col("_seen") == F.col("day_bucket"), F.col("_claimed") == F.col("day_bucket")
    counts = each.groupBy("day_bucket", "source_country", "source").agg(
        F.count_if(is_seen).alias("inserted"), F.count_if(is_claimed).alias("published"), F.count_if(is_seen & is_claimed).alias("fresh"),
        F.count_if(is_seen & (F.col("_claimed") < F.col("day_bucket"))).alias("late")
    )
    return by_country(with_country(counts, catalog, ("day_bucket",)), ("day_bucket", "country"))


def latest_windows(series: DataFrame) -> DataFrame:
    return series.agg(
        F.min("day_bucket").alias("first_day"), F.max("day_bucket").alias("last_day"), F.countDistinct("day_bucket").alias("days"),
        F.countDistinct("country").alias("countries")
    )


def day_rows(series: DataFrame, first: str, last: str) -> DataFrame:
    return series.filter(F.col("day_bucket").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(
        "day_bucket", "country", "published", "inserted", "fresh", "late", "active_sources", "top1_bps"
    )


def month_week(day: Column) -> Column:
    """Days 1-7 are week 1, and so on; not the ISO week."""
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")


def period_totals(series: DataFrame) -> DataFrame:
    return series.groupBy(F.trunc("day_bucket", "month").alias("month"), month_week(F.col("day_bucket")).alias("week")).agg(
        F.sum("published").alias("published"), F.sum("inserted").alias("inserted"), F.sum("fresh").alias("fresh"), F.sum("late").alias("late"), F.countDistinct("day_bucket").alias("days"), F.max("active_sources").alias("peak_active_sources")
    )


def period_countries(series: DataFrame) -> DataFrame:
    """Per country: sums, the mean of active sources and the share of the largest source weighted by what was published."""
    weighted = F.sum(
        F.col("top1_bps") * F.col("published")
    ).cast("decimal(38,0)") / F.nullif(F.sum("published"), F.lit(0)).cast("decimal(20,0)")
    return series.groupBy(F.trunc("day_bucket", "month").alias("month"), month_week(F.col("day_bucket")).alias("week"), "country").agg(
        F.sum("published").alias("published"), F.sum("late").alias("late"), F.round(F.sum("active_sources").cast("decimal(20,0)") / F.count("*").cast("decimal(20,0)")).cast("long").alias("mean_active_sources"), F.round(weighted).cast("long").alias("top1_bps")
    )


def response(hour: DataFrame, day: DataFrame, week: DataFrame) -> DataFrame:
    """Countries of any window, with zero where a window lacks them."""
    h = hour.select("country", F.col("published").alias("published_24h"), F.col("inserted_1h").alias("inserted_1h"))
    d = day.select("country", F.col("published").alias("published_day"), F.col("top5_bps").alias("top5_bps_day"))
    w = week.groupBy("country").agg(F.sum("published").alias("published_week"))
    return h.join(d, "country", "full").join(w, "country", "full").na.fill(0)


def parity(stored: DataFrame, counted: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows that one side lacks and metrics that differ."""
    a = stored.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics], F.lit(True).alias("_a"))
    b = counted.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics], F.lit(True).alias("_b"))
    differ = [F.when(~F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}")), F.lit(m)) for m in metrics]
    status = F.when(F.col("_a").isNull(), "missing_stored").when(F.col("_b").isNull(), "missing_counted").otherwise(
        F.array_join(F.array_compact(F.array(*differ)), ",")
    )
    return a.join(b, keys, "full").select(*keys, status.alias("difference")).filter("difference <> ''")


