"""Structured Streaming jobs: counters by hour, sliding windows, incremental article merge, watermarks and the breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import failure_kind
from ..operators.folds import as_time, next_state
from ..operators.merge import merge_into


def hourly_counters(attempts: DataFrame, late: str = "7 days", width: str = "1 hour") -> DataFrame:
    """Counters of tumbling windows by outlet and method; rows later than the limit are dropped."""
    return attempts.withWatermark("ran_at", late).groupBy(F.window("ran_at", width).alias("w"), "outlet_id", "method").agg(
        F.count_if("attempted").alias("attempted_runs"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failed_runs"), F.sum("fetched_count").alias("fetched_count")
    ).select(F.col("w.start").alias("bucket"), "outlet_id", "method", "attempted_runs", "failed_runs", "fetched_count")


def sliding_counts(articles: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Articles of each publisher country in windows that slide by the hour."""
    return articles.withWatermark("created_at", late).groupBy(
        F.window("created_at", width, step).alias("w"), F.coalesce("source_country", F.lit("(unknown)")).alias("country")
    ).agg(F.count("*").alias("articles")).select(F.col("w.end").alias("window_end"), "country", "articles")


def merge_articles(path: str, buckets: int = 64):
    """A foreachBatch function that upserts each micro-batch into the article table; running one again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            merge_into(batch, path, buckets)

    return run


def endpoint_watermarks(items: DataFrame) -> DataFrame:
    """The newest publication of each endpoint, kept per key: not an event-time watermark, which would be global."""
    return items.groupBy("outlet_id", "method").agg(F.max("published_at").alias("last_publication_at"))


def breaker(attempts: DataFrame) -> DataFrame:
    """The breaker's state of each outlet after each micro-batch, from attempts in order."""
    duplicate = F.col("duplicate") if "duplicate" in attempts.columns else F.lit(False)
    found = attempts.filter("attempted").select(
        "outlet_id", F.unix_micros("ran_at").alias("at"), "id", "ok", failure_kind(F.col("status_code"), F.col("error")).alias("f"),
        F.coalesce(duplicate, F.lit(False)).alias("duplicate")
    )
    rows = found.select("outlet_id", "at", "id", "ok", "f.kind", "f.reason", "duplicate")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("active", None, 0, None, None)
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            now = next_state(now, int(r.at), r.ok, r.kind, r.reason, r.duplicate)
        state.update(now)
        out = pd.DataFrame([(key[0], *now)], columns=["outlet_id", "status", "reason", "failures", "until", "since"])
        yield out.astype({"until": "Int64", "since": "Int64"})

    schema = "status string, reason string, failures long, until long, since long"
    states = rows.groupBy("outlet_id").applyInPandasWithState(
        step, f"outlet_id string, {schema}", schema, "update", GroupStateTimeout.NoTimeout
    )
    return states.select(
        "outlet_id", "status", "reason", "failures", as_time(F.col("until")).alias("disabled_until"),
        as_time(F.col("since")).alias("disabled_since")
    )
