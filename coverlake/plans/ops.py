"""Operations: feed health listings, failure reasons, watchlists and stability, over the table of fetch attempts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, percent
from ..operators.relational import latest, leading_run, mode, with_totals_of


def rollup(runs: DataFrame, unit: str = "hour") -> DataFrame:
    """Additive counters by bucket, runner, outlet and method."""
    return runs.groupBy(F.date_trunc(unit, "ran_at").cast("timestamp_ntz").alias("bucket"), "runner", "outlet_id", "method").agg(
        F.count_if("attempted").alias("attempted_runs"), F.count_if(F.col("attempted") & F.col("ok")).alias("successful_runs"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failed_runs"),
        F.sum("fetched_count").alias("fetched_count"), F.sum("parsed_count").alias("valid_count"), F.sum("missing_title_count").alias("missing_title_count"), F.sum("missing_link_count").alias("missing_link_count"),
    )


def listing(rolled: DataFrame, as_of: str, hours: int = 48, runner: str = "worker", k: int = 200) -> DataFrame:
    rows = rolled.filter(
        (F.col("runner") == runner) & (F.col("bucket") >= before(as_of, f"{hours} hours")) & (F.col("bucket") <= at(as_of))
    )
    return rows.orderBy(F.desc("bucket"), F.asc("outlet_id"), F.asc("method")).limit(k)


def failed(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("attempted") & ~F.col("ok"))


def reason() -> Column:
    """Status code and error text, whichever there are."""
    return F.coalesce(
        F.nullif(F.concat_ws(" ", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")), blank_to("error")), F.lit("")),
        F.lit("unknown")
    )


def failure_reasons(runs: DataFrame, as_of: str, days: int = 30, k: int = 50) -> DataFrame:
    rows = failed(runs).filter((F.col("ran_at") >= before(as_of, f"{days} days")) & (F.col("ran_at") <= at(as_of)))
    return rows.groupBy("method", reason().alias("reason")).agg(
        F.count("*").alias("failures"), F.countDistinct("source").alias("sources")
    ).orderBy(F.desc("failures"), "method", "reason").limit(k)


def failure_class() -> Column:
    """Blocked, gone, refused for now, or other."""
    return F.when(
        F.col("status_code").isin(401, 403, 429), "blocked"
    ).when(F.col("status_code").isin(404, 410), "permanent").when(F.col("status_code") >= 500, "temporary").otherwise("other")


def latest_diagnostics(runs: DataFrame, as_of: str, minutes: int = 2880) -> DataFrame:
    rows = runs.filter((F.col("ran_at") >= before(as_of, f"{minutes} minutes")) & (F.col("ran_at") <= at(as_of)))
    return latest(rows, ["outlet_id", "method"], F.desc("ran_at"), F.desc("id")).select(
        "outlet_id", "method", "ran_at", "ok", "status_code", "fetched_count"
    )


def day_summary(runs: DataFrame, articles: DataFrame, as_of: str) -> DataFrame:
    """Countries of either side: attempts and articles of the last 24 hours; seen and duplicates are not recorded."""
    since = before(as_of, "24 hours")
    r = runs.filter((F.col("ran_at") >= since) & (F.col("ran_at") <= at(as_of))).groupBy("country").agg(
        F.count_if("attempted").alias("attempts"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failures"),
        F.countDistinct("source").alias("run_sources")
    )
    a = articles.filter((F.col("created_at") >= since) & (F.col("created_at") <= at(as_of))).groupBy(blank_to("source_country", "Global").alias("country")).agg(
        F.count("*").alias("inserted"), F.countDistinct("source").alias("sources")
    )
    zero = F.lit(0).cast("long")
    return r.join(a, "country", "full").na.fill(0).select(
        "country", "attempts", "failures", "run_sources", "inserted", "sources", zero.alias("seen_total"), zero.alias("duplicates")
    )


def failing_endpoints(runs: DataFrame, as_of: str, minutes: int = 60, least: int = 4, percent_failed: float = 90.0) -> DataFrame:
    rows = runs.filter((F.col("ran_at") >= before(as_of, f"{minutes} minutes")) & (F.col("ran_at") <= at(as_of)))
    counts = rows.groupBy("outlet_id", "method").agg(
        F.count_if("attempted").alias("attempts"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failures")
    )
    rate = percent(F.col("failures"), F.greatest("attempts", F.lit(1)))
    return counts.withColumn("fail_percent", rate).filter((F.col("attempts") >= least) & (F.col("fail_percent") >= percent_failed))


def earliest_and_recent(articles: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """First seen ever, and recent counts, by source."""
    return articles.groupBy("source").agg(
        F.min("created_at").alias("earliest"),
        F.count_if((F.col("created_at") >= before(as_of, f"{hours} hours")) & (F.col("created_at") <= at(as_of))).alias("recent")
    ).filter("recent > 0")


def paged(df: DataFrame, sort: str, descending: bool, tie: str, page: int, size: int) -> DataFrame:
    """One page with the total of all; the total comes from an aggregate of its own, not a window over all rows."""
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return with_totals_of(df.orderBy(order, F.asc(tie)).offset((page - 1) * size).limit(size), df, F.count("*").alias("total"))


def outlet_table(runs: DataFrame, as_of: str) -> DataFrame:
    past = runs.filter(F.col("ran_at") <= at(as_of))
    lag = F.unix_seconds(at(as_of).cast("timestamp")) - F.unix_seconds(F.max("ran_at").cast("timestamp"))
    return past.groupBy("outlet_id").agg(
        F.count("*").alias("runs"), F.max("ran_at").alias("last_ran_at"), F.round(lag / 3600.0, 3).alias("lag_hours"),
        F.sum("fetched_count").alias("fetched")
    )


def head_watchlist(
    articles: DataFrame, runs: DataFrame, as_of: str, hours: int = 240, least_created: int = 10, days: int = 30
) -> DataFrame:
    """Sources that bring much, their hourly peak against what one fetch returns.

    STRICT if the peak reaches the least fetch, ONE_MISS if it reaches half of it.
    """
    head = articles.filter(
        (F.col("created_at") > before(as_of, f"{hours} hours")) & (F.col("created_at") <= at(as_of))
    ).groupBy("source").agg(F.count("*").alias("created")).filter(F.col("created") >= least_created)
    by_hour = articles.filter(
        (F.col("publication_datetime") > before(as_of, f"{days} days")) & (F.col("publication_datetime") <= at(as_of))
    ).groupBy("source", F.date_trunc("hour", "publication_datetime").alias("h")).agg(F.count("*").alias("n"))
    peaks = by_hour.groupBy("source").agg(F.max("n").alias("peak_1h"))
    good = F.col("attempted") & F.col("ok") & (F.col("method") == "rss")
    worker = runs.filter(
        (F.col("runner") == "worker") & (F.col("ran_at") > before(as_of, f"{hours} hours")) & (F.col("ran_at") <= at(as_of))
    )
    fetched = worker.groupBy("source").agg(
        F.count_if(good).alias("rss_ok"), F.count_if(F.col("attempted") & ~F.col("ok") & (F.col("method") == "rss")).alias("rss_failed"),
        F.min(F.when(good, F.col("fetched_count"))).alias("min_fetched"),
        F.expr(
            "cast(percentile_disc(0.5) within group (order by fetched_count) filter (where attempted and ok and method = 'rss') as long)"
        ).alias("median_fetched"),
        F.count_if(good & F.col("sample_capped")).alias("capped")
    )
    rows = head.join(peaks, "source", "left").join(fetched, "source", "left")
    band = F.when(
        F.col("min_fetched").isNull() | F.col("peak_1h").isNull(), "UNKNOWN"
    ).when(F.col("peak_1h") >= F.col("min_fetched"), "STRICT").when(
        2 * F.col("peak_1h") >= F.col("min_fetched"), "ONE_MISS"
    ).otherwise("SAFE")
    return rows.na.fill(0, ["rss_ok", "rss_failed", "capped"]).withColumn("band", band)


def failure_watchlist(
    runs: DataFrame, as_of: str, days: int = 30, least: int = 12, failures: int = 20, in_a_row: int = 18, rate_off: float = 0.9,
    gone: float = 0.8, rate_watch: float = 0.6
) -> DataFrame:
    """Endpoints by failures: how many in a row lead, the most frequent reason, and what to do. An endpoint that never worked goes
    for a share of lasting failures alone."""
    rows = runs.filter(
        F.col("attempted") & (F.col("ran_at") >= before(as_of, f"{days} days")) & (F.col("ran_at") <= at(as_of))
    ).withColumn("reason", F.when(~F.col("ok"), reason())).withColumn("class", F.when(~F.col("ok"), failure_class()))
    keys, order = ["outlet_id", "method"], (F.desc("ran_at"), F.desc("id"))
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"),
        F.count_if(F.col("class") == "permanent").alias("permanent")
    ).filter(F.col("attempts") >= least)
    lead = leading_run(rows, keys, F.col("ok"), *order)
    top = mode(rows, keys, "reason", *order)
    rate = F.round(F.col("failures") / F.col("attempts"), 4)
    never = (F.col("failures") == F.col("attempts")) & (F.col("permanent") >= gone * F.col("failures"))
    action = F.when(
        (F.col("failures") >= failures) & (F.col("run") >= in_a_row) & ((F.col("fail_rate") >= rate_off) | never), "DISABLE"
    ).when(F.col("fail_rate") >= rate_watch, "WATCH").otherwise("OK")
    return counts.join(lead, keys).join(top, keys, "left").withColumn("fail_rate", rate).withColumn("action", action).withColumnRenamed("run", "leading_failures")


def stale_watchlist(
    runs: DataFrame, as_of: str, days: int = 14, archive: str = r"sitemap|archive|googlenews|\.xml\.gz", archive_year: int = 2020,
    high_value_countries: tuple[str, ...] = (), high_value_sources: str | None = None
) -> DataFrame:
    """Sources whose newest item, over all latest successful attempts, is old; with their methods in order.

    The first that holds: dated in the future; an archive, read by sitemap only, whose name or address says so or whose newest
    item is from before a year; of high value by country or name; old enough to be disabled at once; a candidate.
    """
    good = runs.filter(F.col("attempted") & F.col("ok") & F.col("newest_item_published_at").isNotNull() & (F.col("ran_at") <= at(as_of)))
    newest = latest(good, ["source", "method"], F.desc("ran_at"), F.desc("id"))
    says = F.lower(F.concat_ws(" ", "source", F.coalesce("requested_url", F.lit("")))).rlike(archive)
    valued = F.coalesce(F.col("country").isin(*high_value_countries), F.lit(False)) if high_value_countries else F.lit(False)
    valued = valued | F.lower("source").rlike(high_value_sources) if high_value_sources else valued
    rows = newest.groupBy("source").agg(
        F.max("newest_item_published_at").alias("newest"), F.array_join(F.array_sort(F.collect_list("method")), "+").alias("methods"),
        F.bool_or(says).alias("_archive"), F.bool_or(valued).alias("_valued")
    )
    age = F.datediff(F.to_date(at(as_of)), F.to_date("newest")).cast("long")
    stored = F.col("_archive") | (F.year("newest") < archive_year)
    action = F.when(F.col("age_days") <= -1, "future_hold").when(
        (F.col("methods") == "sitemap") & (F.col("age_days") >= 30) & stored, "archive_exempt"
    )
    action = action.when(F.col("_valued"), "high_value_hold").when(F.col("age_days") >= 2 * days, "disable").otherwise("candidate")
    return rows.withColumn("age_days", age).filter(
        (F.col("age_days") >= days) | (F.col("age_days") <= -1)
    ).withColumn("action", action).drop("_archive", "_valued")


def repair_pairs(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """For each endpoint whose newest attempt failed, the best other address of the outlet that worked."""
    rows = runs.filter(F.col("attempted") & (F.col("ran_at") >= before(as_of, f"{days} days")) & (F.col("ran_at") <= at(as_of)))
    newest = latest(rows, ["outlet_id", "method", "requested_url"], F.desc("ran_at"), F.desc("id"))
    bad = newest.filter(~F.col("ok")).select("outlet_id", F.col("method").alias("fail_method"), F.col("requested_url").alias("fail_url"))
    good = newest.filter("ok").select(
        "outlet_id", F.col("method").alias("success_method"), F.col("requested_url").alias("success_url"), "fetched_count", "ran_at"
    )
    pairs = bad.join(good, "outlet_id").filter("fail_url <> success_url")
    best = latest(
        pairs, ["outlet_id", "fail_url"], F.desc(F.col("fail_method") == F.col("success_method")), F.desc("fetched_count"),
        F.desc("ran_at"), F.asc("success_url")
    )
    swap = F.when(
        F.col("fail_method") != F.col("success_method"), F.concat_ws("->", "fail_method", "success_method")
    ).otherwise("same_method")
    return best.select("outlet_id", "fail_url", "success_url", "fetched_count", swap.alias("swap"))


def blocked_backlog(runs: DataFrame, catalog: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Endpoints last refused with 403, whether another address works, and the step to take."""
    rows = runs.filter(F.col("attempted") & (F.col("ran_at") >= before(as_of, f"{days} days")) & (F.col("ran_at") <= at(as_of)))
    newest = latest(rows, ["source", "method"], F.desc("ran_at"), F.desc("id"))
    refused = newest.filter((F.col("status_code") == 403) & ~F.col("ok")).select("source", "method", "requested_url", "ran_at")
    working = newest.filter("ok").groupBy("source").agg(F.min("requested_url").alias("other_url"))
    listed = catalog.select(F.col("catalog_source").alias("source"), "distribution_class")
    action = F.when(F.col("other_url").isNotNull(), "swap").when(F.col("method") == "rss", "cooldown").otherwise("review")
    return refused.join(working, "source", "left").join(listed, "source", "left").select(
        "source", "method", "requested_url", "ran_at", "other_url", F.col("distribution_class").isNotNull().alias("in_catalog"),
        action.alias("action")
    )


def stability(runs: DataFrame, as_of: str, days: int = 14, least: int = 4, stable: int = 5, warning: int = 20) -> DataFrame:
    rows = runs.filter(F.col("attempted") & (F.col("ran_at") >= before(as_of, f"{days} days")) & (F.col("ran_at") <= at(as_of)))
    totals = rows.groupBy("source", "method").agg(
        F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.sum("parsed_count").alias("valid"),
        F.countDistinct(F.to_date("ran_at")).alias("days")
    )
    rate = 100.0 * F.col("successes") / F.col("attempts")
    status = F.when(
        F.col("attempts") < least, "no_data"
    ).when(F.col("valid") == 0, "unstable").when(rate >= 100 - stable, "stable").when(
        rate >= 100 - warning, "warning"
    ).otherwise("unstable")
    return totals.withColumn("status", status)


def report(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Totals by method and country in one pass, with totals of both."""
    rows = runs.filter((F.col("ran_at") >= before(as_of, f"{days} days")) & (F.col("ran_at") <= at(as_of)))
    totals = rows.rollup("method", "country").agg(
        F.count_if("attempted").alias("attempted"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failed"),
        F.sum("fetched_count").alias("fetched")
    )
    return totals.select(
        F.coalesce("method", F.lit("(all)")).alias("method"), F.coalesce("country", F.lit("(all)")).alias("country"), "attempted", "failed",
        "fetched", F.when(F.col("failed") > 0, "degraded").otherwise("ok").alias("status")
    )


#: Columns that a listing of fetch attempts may be sorted by; names first up, numbers first down.
SORTS = {
    "bucket": "hour_bucket", "fetchedCount": "fetched_count", "validCount": "valid_count", "failedRuns": "failed_runs",
    "attemptedRuns": "attempted_runs", "source": "source", "country": "country"
}


def sort_column(asked: str | None, direction: str | None, sorts: dict[str, str], default: str) -> tuple[str, bool]:
    """(column, descending): only a column that is listed, else the default; without a direction names go up, others down."""
    column = sorts.get(asked or "", sorts[default])
    return column, direction == "desc" if direction in ("asc", "desc") else column not in ("source", "country")


def mentions_text(q: str, *columns: str) -> Column:
    """Whether a column holds the text, in any case; its % and _ are no wild cards."""
    return reduce(or_, [F.lower(F.coalesce(c, F.lit(""))).contains(q.lower()) for c in columns])


def of_outlets_or_sources(outlets: list[str], sources: list[str], outlet: str = "outlet_id", source: str = "source") -> Column:
    """Outlets if any are given, else sources if any are, else all."""
    return F.col(outlet).isin(outlets) if outlets else F.col(source).isin(sources) if sources else F.lit(True)


def run_table(
    runs: DataFrame, as_of: str, hours: int = 24, q: str = "", outlets: list[str] | None = None, sources: list[str] | None = None,
    sort: str | None = None, direction: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of attempts by hour, searched and sorted, with the total of all pages."""
    since = before(as_of, f"{min(max(hours, 1), 720)} hours")
    rows = runs.filter(of_outlets_or_sources(outlets or [], sources or []))
    if q.strip():
        rows = rows.filter(mentions_text(q.strip(), "source", "outlet_id", "country"))
    by_hour = rows.groupBy(F.date_trunc("hour", "ran_at").cast("timestamp_ntz").alias("hour_bucket"), "outlet_id", "source", "country", "method").agg(
        F.count_if("attempted").alias("attempted_runs"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failed_runs"), F.sum("fetched_count").alias("fetched_count"), F.sum("parsed_count").alias("valid_count")
    )
    kept = by_hour.filter((F.col("hour_bucket") > since) & (F.col("hour_bucket") <= at(as_of)))
    column, down = sort_column(sort, direction, SORTS, "bucket")
    order = [F.desc_nulls_last(column) if down else F.asc_nulls_last(column), F.desc("hour_bucket"), F.asc("outlet_id"), F.asc("method")]
    page = kept.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 200))
    return with_totals_of(page, kept, F.count("*").alias("total"))


def write_report(df: DataFrame, path: str, title: str, *order: Column) -> None:
    """The report as one CSV table under path/csv and as Markdown lines under path/md; reports are short listings."""
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    markdown(rows, title).coalesce(1).write.mode("overwrite").text(f"{path}/md")


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """Lines of a Markdown table: a heading, the column names and the rows; bars and line ends in values are kept from breaking it."""
    names = rows.columns
    head = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    cell = lambda c: F.regexp_replace(
        F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " "
    )
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("value"))
    top = rows.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    return top.unionByName(body)
