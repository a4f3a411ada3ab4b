"""The breaker with timers, ledgers that batches pass twice, and late rows, as streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from coverlake.functions.scalars import failure_kind
from coverlake.operators import folds
from coverlake.streaming import breaker, late, ledger

T = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)
ATTEMPTS = "outlet_id string, ran_at timestamp, id long, attempted boolean, ok boolean, status_code int, error string"


def run(df, path, sink=None, name=None):
    q = df.writeStream.outputMode("update").option("checkpointLocation", str(path)).trigger(availableNow=True)
    q = (q.foreachBatch(sink) if sink else q.format("memory").queryName(name)).start()
    q.awaitTermination(180)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, breaker.ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_breaker_with_timers(spark, rocksdb, tmp_path):
    def fail(outlet, day, n, code=503):
        return (outlet, T + day * DAY, n, True, False, code, None)

    batches = [
        [fail("a", 0, 1), fail("a", 0.1, 2), fail("b", 0, 3), fail("c", 0, 4, 410), ("d", T, 5, True, True, 200, None), ("e", T, 6, False, False, 503, None)],
        [("b", T + 1 * DAY, 7, True, True, 200, None), fail("b", 0.5, 8), fail("d", 1, 9, None)],  # what comes late in a batch is put in order
        [("x", T + 9 * DAY, 10, True, True, 200, None)],  # a's date passes without an attempt on it
        [fail("a", 9.5, 11, None), fail("b", 9.6, 12), fail("x", 10, 13, 404), fail("x", 10.1, 14, 404), fail("x", 10.2, 15, 404)],
        [("y", T + 41 * DAY, 16, True, True, 200, None)],  # and c's, and x's
        [("y", T + 120 * DAY, 17, True, True, 200, None)],
        [("y", T + 121 * DAY, 18, True, True, 200, None)],
    ]
    landed = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(str(landed))
        stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(landed))
        run(
            breaker.breaker(stream).withColumn("batch", F.lit(k)), tmp_path / "state",
            sink=lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))
        )
        if k == 4:
            attempts = spark.read.parquet(str(landed)).filter("attempted").withColumn(
                "failure", failure_kind(F.col("status_code"), F.col("error"))
            ).withColumn("duplicate", F.lit(False))
            whole = {
                r["outlet_id"]: (r["status"], r["reason"], r["failures"], r["disabled_until"], r["disabled_since"])
                for r in folds.breaker_states(attempts.select("outlet_id", "ran_at", "id", "ok", "failure", "duplicate")).collect()
            }
            out = spark.read.parquet(str(tmp_path / "out"))
            last = out.filter("event = 'attempt'").groupBy("outlet_id").agg(
                F.max_by(
                    F.struct("status", "reason", "failures", "disabled_until", "disabled_since"), F.struct("last_attempted_at", "batch")
                ).alias("s")
            ).collect()
            assert {r["outlet_id"]: tuple(r["s"]) for r in last} == whole
            assert {k: v[0] for k, v in whole.items()} == {
                "a": "disabled_temporary", "b": "active", "c": "disabled_permanent", "d": "active", "x": "disabled_permanent", "y": "active"
            }
    out = spark.read.parquet(str(tmp_path / "out"))
    events = sorted((r["outlet_id"], r["event"], r["batch"]) for r in out.filter("event <> 'attempt'").collect())
    due = [e[:2] for e in events if e[1] == "due"]
    assert due.count(("a", "due")) >= 2 and ("c", "due") in due and ("x", "due") in due and not any(
        e[0] in ("b", "d", "y") for e in events if e[1] == "due"
    )
    assert {e[0] for e in events if e[1] == "forgotten"} == {"a", "b", "c", "d", "x"}


ROWS = "id long, bucket timestamp, outlet string, runs long, bytes long"


def test_ledger(spark, tmp_path):
    path, keys, counters = str(tmp_path / "t"), ["bucket", "outlet"], ["runs", "bytes"]
    assert ledger.read_sums(spark, path, keys, counters) is None and ledger.read_rows(spark, path) is None

    def batch(k):
        return spark.createDataFrame([(10 * k + j, T, "ab"[j % 2], 1, 10 * k + j) for j in range(4)], ROWS)

    def sums():
        return {r["outlet"]: (r["runs"], r["bytes"]) for r in ledger.read_sums(spark, path, keys, counters).collect()}

    def want(*ks):
        return {x: (2 * len(ks), sum(20 * k + 2 + 2 * j for k in ks)) for j, x in enumerate("ab")}

    assert all(ledger.append(batch(k), path, k, keys, counters) for k in (0, 1, 1))
    assert sums() == want(0, 1)
    assert ledger.compact(spark, path, keys, counters) == 1 and sums() == want(0, 1)
    assert not ledger.append(batch(0), path, 0, keys, counters) and sums() == want(0, 1)  # a replay from before the base
    # a batch that broke off has no entry in the ledger and does not count until it has run again
    batch(2).write.parquet(f"{path}/rows/batch=2")
    batch(2).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]).write.parquet(f"{path}/sums/batch=2")
    assert sums() == want(0, 1)
    assert ledger.append(batch(2), path, 2, keys, counters) and sums() == want(0, 1, 2)
    assert ledger.compact(spark, path, keys, counters) == 2 and sums() == want(0, 1, 2)
    assert ledger.read_rows(spark, path).count() == 12


def test_ledger_stream(spark, tmp_path):
    path, keys, counters = str(tmp_path / "t"), ["bucket", "outlet"], ["runs", "bytes"]
    for k in range(2):
        spark.createDataFrame([(k, T, "a", 1, 5)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), tmp_path / "c", sink=ledger.sink(path, keys, counters))
    run(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), tmp_path / "c2", sink=ledger.sink(path + "2", keys, counters))
    for p in (path, path + "2"):
        assert [(r["runs"], r["bytes"]) for r in ledger.read_sums(spark, p, keys, counters).collect()] == [(2, 10)]


def test_late_rows_stay(spark, tmp_path):
    schema = "id long, publication_datetime timestamp, created_at timestamp"
    now = T + 30 * DAY
    rows = [
        (1, now - 1 * DAY, now), (2, now - 2 * DAY, now), (3, now - 7 * DAY, now), (4, now - 7.1 * DAY, now), (5, None, now),
        (6, now + DAY, now)
    ]
    older = [(7, T, T + DAY)]  # a batch from weeks ago comes after it
    for k, some in enumerate((rows, older)):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tmp_path / "c", sink=late.land(str(tmp_path / "out")))
    kept = {r["id"]: r["lateness"] for r in spark.read.parquet(str(tmp_path / "out/items")).collect()}
    assert kept == {1: "fresh", 2: "late", 3: "late", 5: "undated", 6: "fresh", 7: "fresh"}
    assert {
        r["lateness"]: r["n"]
        for r in spark.read.parquet(str(tmp_path / "out/counts")).groupBy("lateness").agg(F.sum("n").alias("n")).collect()
    } == {"fresh": 3, "late": 2, "old": 1, "undated": 1}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = late.by_hour(stream).writeStream.outputMode("complete").format("memory").queryName("by_hour").option(
        "checkpointLocation", str(tmp_path / "c3")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["fresh"], r["late"], r["old"], r["undated"]) for r in spark.table("by_hour").collect()) == [(1, 0, 0, 0), (2, 2, 1, 1)]
