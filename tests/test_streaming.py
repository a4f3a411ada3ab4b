"""Streaming jobs from files, run to their end, and the fold operators behind them."""

import datetime

import pytest
from pyspark.sql import functions as F

from coverlake.operators import folds, merge
from coverlake.streaming import jobs

T = datetime.datetime(2024, 1, 1)
ATTEMPTS = "outlet_id string, method string, ran_at timestamp, id long, attempted boolean, ok boolean, status_code int, error string, fetched_count long"


def attempts():
    hour = datetime.timedelta(hours=1)
    return [
        ("a", "rss", T + k * hour, k, True, k == 0, 200 if k == 0 else 503, None, k) for k in range(4)
    ] + [("b", "rss", T, 9, True, False, 410, None, 0), ("c", "rss", T, 10, False, True, None, None, 5)]


def run(spark, df, sink, path, mode="update"):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True)
    q = (q.foreachBatch(sink) if callable(sink) else q.format("memory").queryName(sink)).start()
    q.awaitTermination(120)
    return q


@pytest.fixture
def landed(spark, tmp_path):
    spark.createDataFrame(attempts(), ATTEMPTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ATTEMPTS).parquet(str(tmp_path / "in"))


def test_hourly(spark, landed, tmp_path):
    run(spark, jobs.hourly_counters(landed), "hourly", tmp_path / "c1", "complete")
    got = {(r["outlet_id"], r["bucket"].hour): (r["attempted_runs"], r["failed_runs"]) for r in spark.table("hourly").collect()}
    assert got == {("a", 0): (1, 0), ("a", 1): (1, 1), ("a", 2): (1, 1), ("a", 3): (1, 1), ("b", 0): (1, 1), ("c", 0): (0, 0)}


def test_breaker(spark, landed, tmp_path):
    run(spark, jobs.breaker(landed), "breaker", tmp_path / "c2")
    got = {r["outlet_id"]: (r["status"], r["reason"], r["failures"]) for r in spark.table("breaker").collect()}
    assert got == {"a": ("disabled_temporary", "http_503", 3), "b": ("disabled_permanent", "http_410", 1)}


def test_breaker_batch(spark):
    from coverlake.functions.scalars import failure_kind

    df = spark.createDataFrame(attempts(), ATTEMPTS).filter("attempted").withColumn(
        "failure", failure_kind(F.col("status_code"), F.col("error"))
    )
    got = {
        r["outlet_id"]: (r["status"], r["failures"])
        for r in folds.breaker_states(df.select("outlet_id", "ran_at", "id", "ok", "failure", F.lit(False).alias("duplicate"))).collect()
    }
    assert got == {"a": ("disabled_temporary", 3), "b": ("disabled_permanent", 1)}


ARTICLE = "external_id string, stable_id string, publication_datetime timestamp, created_at timestamp, source string, source_country string, title_original string, title_quality string, url string, primary_section string, primary_topic string, feed_categories array<string>, topics array<string>, sections_normalized array<string>, seq long"


def article(i, title, quality, seq, created=T, topics=("t",)):
    return (i, None, T, created, "s", None, title, quality, f"https://e.org/{i}", None, None, ["c"], list(topics), [], seq)


def test_merge(spark, tmp_path):
    path = str(tmp_path / "articles")
    one = spark.createDataFrame(
        [article("1", "Good", "ok", 1), article("1", "Better", "recovered", 2), article("2", "Two", "ok", 3)], ARTICLE
    )
    merge.merge_into(one, path, 4)
    later = T + datetime.timedelta(days=1)
    two = spark.createDataFrame([article("1", "123456", "suspect", 4, later, ["u"]), article("3", "Three", "ok", 5)], ARTICLE)
    for _ in range(2):  # running a batch again changes nothing
        merge.merge_into(two, path, 4)
        got = {r["external_id"]: r for r in spark.read.parquet(path).collect()}
        assert {k: (r["title_original"], r["title_quality"]) for k, r in got.items()} == {
            "1": ("Better", "recovered"), "2": ("Two", "ok"), "3": ("Three", "ok")
        }
        assert got["1"]["topics"] == ["t", "u"] and got["1"]["created_at"] == T


def test_merge_stream(spark, tmp_path):
    for k, rows in enumerate([[article("1", "Good", "ok", 1)], [article("1", "New", "ok", 2), article("2", "Two", "ok", 3)]]):
        spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ARTICLE).parquet(str(tmp_path / "in"))
        run(spark, stream, jobs.merge_articles(str(tmp_path / "out"), 4), tmp_path / "c3")
        got = {r["external_id"]: r["title_original"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == ({"1": "Good"} if k == 0 else {"1": "New", "2": "Two"})


def test_greedy_order(spark):
    rows = [("n", "a", t) for t in "wxyz"] + [("n", "b", t) for t in "xyq"] + [("n", "c", t) for t in "pqr"]
    got = folds.greedy_order(spark.createDataFrame(rows, "network string, source string, title string")).orderBy("rank").collect()
    assert [(r["source"], r["lift"], r["duplicates"]) for r in got] == [("a", 4, 0), ("c", 3, 0), ("b", 0, 3)]


@pytest.mark.parametrize("candidates", [1, 3, 256])
def test_greedy_order_against_plain_steps(spark, candidates):
    import random

    rng = random.Random(4)
    rows = {
        (network, f"s{int(rng.triangular(0, 14, 2))}", f"t{rng.randint(0, 60)}") for network in ("n", "m", None) for _ in range(150)
    } | {("one", "only", "t"), ("n", None, "t0"), ("n", "s1", None)}
    want = []
    for network in ("n", "m", None, "one"):
        own = {}
        for n, s, t in rows:
            if n == network and s is not None:
                own.setdefault(s, set()).add(t)
        covered, rank = set(), 0
        while own:
            best = min(own, key=lambda s: (-len(own[s] - covered), -len(own[s]), s))
            rank, new = rank + 1, len(own[best] - covered)
            want.append((network, best, rank, new, len(own[best]) - new))
            covered |= own.pop(best)
    df = spark.createDataFrame(sorted(rows, key=repr), "network string, source string, title string")
    assert sorted(map(tuple, folds.greedy_order(df, candidates).collect()), key=repr) == sorted(want, key=repr)
    assert folds.greedy_order(df.limit(0), candidates).collect() == []


@pytest.mark.parametrize("entries", [0, 2_000_000])
def test_greedy_order_of_many_sources_takes_few_rounds(spark, entries, monkeypatch):
    """Sources that share nothing any more, and those past the first 256, do not each wait for a round."""
    import random

    rng = random.Random(7)
    rows = {("n", f"s{s}", f"t{rng.randint(0, 99)}") for s in range(1200) for _ in range(2)} | {("n", f"s{s}", f"own{s}") for s in range(0, 1200, 3)}
    own, covered, want = {}, set(), []
    for _, s, t in rows:
        own.setdefault(s, set()).add(t)
    while own:
        best = min(own, key=lambda s: (-len(own[s] - covered), -len(own[s]), s))
        new = len(own[best] - covered)
        want.append(("n", best, len(want) + 1, new, len(own[best]) - new))
        covered |= own.pop(best)
    made = []
    monkeypatch.setattr(folds, "stored", lambda df, real=folds.stored: made.append(1) or real(df))
    df = spark.createDataFrame(sorted(rows), "network string, source string, title string")
    assert sorted(map(tuple, folds.greedy_order(df, 60, entries).collect())) == sorted(want)
    assert len(made) < 40


def test_clusters(spark):
    hours = [0, 30, 60, 100]
    rows = [("n", "f", str(h), T + datetime.timedelta(hours=h)) for h in hours]
    got = {
        r["external_id"]: (r["cluster"], r["size"])
        for r in folds.syndication_clusters(
            spark.createDataFrame(rows, "network string, fingerprint string, external_id string, published_at timestamp")
        ).collect()
    }
    assert got == {"100": (0, 1), "60": (1, 2), "30": (1, 2), "0": (2, 1)}


def test_clusters_need_a_telling_title(spark):
    from coverlake.plans.ingest import title_fingerprint

    long = "Élection: the «new» Council votes on Budget"
    titles = [
        long, "ELECTION - the new council votes on budget!", "", None, "Too short a title for this", "aa bb cc dd ee ff gg hh ii jj kk ll",
        "a council of four long wordsinarow xx"
    ]
    rows = [
        ("n", t, str(2 * k + j), T + datetime.timedelta(hours=j)) for k, t in enumerate(titles) for j in range(2)
    ] + [(None, long, "x", T)]
    items = spark.createDataFrame(rows, "network string, title string, external_id string, published_at timestamp")
    out = folds.syndication_clusters(items.withColumn("fingerprint", title_fingerprint(items["title"])).drop("title"))
    got = {r["external_id"]: (r["fingerprint"], r["cluster"], r["size"]) for r in out.collect()}
    one = "election the new council votes on budget"
    assert {k: got.pop(k) for k in "0123"} == {k: (one, 0, 4) for k in "0123"}
    assert got.pop("x") == (one, None, 1)
    assert {k: got.pop(k)[1:] for k in ("12", "13")} == {k: (None, 1) for k in ("12", "13")}
    assert set(got.values()) == {(None, None, 1)} and len(got) == 8
