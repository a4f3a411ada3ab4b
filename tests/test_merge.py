"""Deduplication against a plain scan, and what a merge reads."""

import datetime
import random

from pyspark.sql import functions as F

from coverlake.operators import merge

SCHEMA = "external_id string, stable_id string, publication_datetime timestamp, source_country string, title_quality string, feed_categories array<string>, topics array<string>, sections_normalized array<string>, seq long"
ARRAYS, FIRST = ("feed_categories", "topics", "sections_normalized"), ("stable_id", "source_country")
NAMES = SCHEMA.replace(",", "").split(" ")[::2]


def made(n):
    rng, day = random.Random(n), datetime.datetime(2024, 1, 1)
    lists = lambda: rng.choice([None, [], [None], ["b", "a", "a"], [" ", "", None, "c"], [" x", "\t", "!"], ["é", "Z", None]])
    return [
        (
            str(rng.randrange(n // 2)), rng.choice([None, "", f"g{rng.randrange(n)}"]),
            rng.choice([None, day + datetime.timedelta(hours=rng.randrange(3))]), rng.choice([None, " ", "NL", "DE"]),
            rng.choice([None, "ok", "suspect", "recovered"]), lists(), lists(), lists(), k
        )
        for k in range(n)
    ]


def scan(rows, key):
    """dedupe() row by row."""
    rank = lambda r: (
        -{"suspect": 0, "recovered": 2}.get(r["title_quality"], 1), r["publication_datetime"] is None,
        -r["publication_datetime"].timestamp() if r["publication_datetime"] else 0, r["seq"]
    )
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    for own in groups.values():
        own.sort(key=rank)
        yield own[0] | {c: next((r[c] for r in own if (r[c] or "").strip(" ")), None) for c in FIRST} | {
            c: sorted({x for r in own for x in r[c] or [] if x is not None and x.strip(" ")}) for c in ARRAYS
        }


def test_dedupe_against_a_scan(spark):
    rows = made(300)
    got = merge.dedupe_batch(spark.createDataFrame(rows, SCHEMA)).collect()
    once = scan([dict(zip(NAMES, r)) for r in rows], lambda r: r["external_id"] if r["stable_id"] is None else r["stable_id"])
    want = {r["external_id"]: r for r in scan(once, lambda r: r["external_id"])}
    assert {r["external_id"]: r.asDict() for r in got} == want and len(got) == len(want)


def test_dedupe_needs_no_aggregate(spark):
    """Keys that are nearly all distinct would fill one with objects."""
    plan = merge.dedupe_batch(spark.createDataFrame(made(10), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_a_batch_is_deduplicated_once(spark, tmp_path, monkeypatch):
    """Not once more to tell its buckets."""
    rows, seen = spark.createDataFrame(made(60), SCHEMA).withColumns(
        {c: F.lit(None).cast("string") for c in ("url", "title_original", "primary_section", "primary_topic")}
        | {"created_at": F.lit(datetime.datetime(2024, 1, 9))}
    ), spark.sparkContext.accumulator(0)
    inner = merge.dedupe_batch

    def looked_at(r):
        seen.add(1)
        return r is not None

    look = F.udf(looked_at, "boolean").asNondeterministic()
    merge.merge_into(rows, str(tmp_path / "t"), 4)
    n = spark.read.parquet(str(tmp_path / "t")).count()
    monkeypatch.setattr(merge, "dedupe_batch", lambda r: inner(r).filter(look("seq")))
    merge.merge_into(rows, str(tmp_path / "t"), 4)
    assert seen.value == n == spark.read.parquet(str(tmp_path / "t")).count()
