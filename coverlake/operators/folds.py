"""Order-dependent operators: folds over sorted batches and over what grouping leaves of a group."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import stored

#: Fixed values of the circuit breaker: failures in a row and days.
POLICY = {"temporary_after": 2, "temporary_days": 7, "permanent_404_after": 3, "permanent_days": 30}
DAY = 86_400_000_000


def greedy_order(titles: DataFrame, candidates: int = 256, entries: int = 2_000_000) -> DataFrame:
    """(network, source, title): the order in which sources add most titles that no earlier source of the network has.

    Of equal additions the source with more titles goes first, then the first by name.

    What a source adds can only fall, so sources follow each other by what they add when their turn comes, and only that has to be
    found. All that matters of a title is which sources have it, so titles are counted by their set of sources. A source whose
    titles no other has, or that were all taken with earlier ones, has nothing left to find. For the others each round takes the
    most promising sources of each network, ``candidates`` of them and more while the sets they are in come to no more than
    ``entries``, and what the sets that are left hold of these only. A network's greedy steps on that are right as long as the
    best candidate is ahead of the best other source; so a round fixes one source at least and mostly all candidates. No task
    holds more than the sets of candidates that occur together; all sets are dealt out.
    """
    of_title = titles.filter("source is not null").groupBy("network", "title").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    counts = of_title.groupBy("network", "sources").agg(F.count("*").alias("n")).select("*", F.monotonically_increasing_id().alias("_set"))
    counts = stored(counts)
    each = counts.select("network", F.explode("sources").alias("source"), "n", (F.size("sources") == 1).alias("_alone"))
    alone = F.coalesce(F.sum(F.when(F.col("_alone"), F.col("n"))), F.lit(0).cast("long"))
    whole = stored(each.groupBy("network", "source").agg(F.sum("n").alias("total"), alone.alias("alone")))
    same = F.col("network").eqNullSafe(F.col("_network")) & (F.col("source") == F.col("_source"))
    left, done = counts.filter(F.size("sources") > 1), None
    while True:
        members = left.select("network", "_set", "n", F.explode("sources").alias("source"))
        shared = members.groupBy(F.col("network").alias("_network"), F.col("source").alias("_source")).agg(
            F.sum("n").alias("_shared"), F.count("*").alias("_sets")
        )
        known = whole.join(shared, same).select("network", "source", "total", (F.col("alone") + F.col("_shared")).alias("lift"), "_sets")
        order = W.partitionBy("network").orderBy(F.desc("lift"), F.desc("total"), F.asc("source"))
        taken = (F.row_number().over(order) <= candidates) | (F.sum("_sets").over(order) <= entries)
        placed = known.withColumn("_taken", taken).withColumn("_next", F.lag("_taken", 1, True).over(order))
        top = stored(placed.filter("_taken or _next").select("network", "source", "total", "lift", "_taken"))
        if not top.limit(1).count():
            break
        own = top.filter("_taken").select(F.col("network").alias("_network"), F.col("source").alias("_source"))
        of_set = members.join(own, same).groupBy("network", "_set", "n").agg(F.array_sort(F.collect_list("source")).alias("sources"))
        sets = of_set.groupBy("network", "sources").agg(F.sum("n").alias("n")).select(
            "network", "sources", "n", F.lit(0).cast("long").alias("total"), F.lit(False).alias("last")
        )
        rows = sets.unionByName(
            top.select("network", F.array("source").alias("sources"), F.col("lift").alias("n"), "total", (~F.col("_taken")).alias("last"))
        )
        picked = stored(rows.groupBy("network").applyInPandas(steps, "_network string, _source string, lift long"))
        done = picked if done is None else done.unionByName(picked)
        covered = members.join(picked, same, "left_semi").select("_set").distinct()
        left = stored(left.join(covered, "_set", "left_anti"))
    if done is None:
        done = whole.sparkSession.createDataFrame([], "_network string, _source string, lift long")
    lifts = whole.join(done, same, "left").select("network", "source", "total", F.coalesce("lift", "alone").alias("lift"))
    rank = F.row_number().over(W.partitionBy("network").orderBy(F.desc("lift"), F.desc("total"), F.asc("source")))
    return lifts.select("network", "source", rank.cast("long").alias("rank"), "lift", (F.col("total") - F.col("lift")).alias("duplicates"))


def steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """A network's greedy steps among candidates, until none has a set that is left. pdf: sets of candidates with their number n
    (total 0), then a row for each candidate with what it adds (n) and its total, and one (last) for the best source that is no
    candidate."""
    network = pdf["network"].iloc[0]
    sets, total, lift, bound = [], {}, {}, None
    for own, n, whole, last in zip(pdf["sources"], pdf["n"].tolist(), pdf["total"].tolist(), pdf["last"].tolist(), strict=True):
        if last:
            bound = (-n, -whole, own[0])
        elif whole:
            total[own[0]], lift[own[0]] = whole, n
        else:
            sets.append((own, n))
    held = defaultdict(list)
    for k, (own, _) in enumerate(sets):
        for s in own:
            held[s].append(k)
    heap = [(-lift[s], -n, s) for s, n in total.items()]
    heapq.heapify(heap)
    covered, left, out = [False] * len(sets), len(sets), []
    while heap and left:
        gain, n, best = heapq.heappop(heap)
        if -gain != lift[best]:  # it fell since; lifts only fall
            heapq.heappush(heap, (-lift[best], n, best))
            continue
        if bound is not None and (gain, n, best) > bound:
            break
        out.append((network, best, -gain))
        for k in held[best]:
            if not covered[k]:
                covered[k] = True
                left -= 1
                for s in sets[k][0]:
                    lift[s] -= sets[k][1]
    return pd.DataFrame(out, columns=["_network", "_source", "lift"])


def syndication_clusters(items: DataFrame, hours: int = 36) -> DataFrame:
    """(network, fingerprint, external_id, published_at): clusters of one title within a band of time of the cluster's own
    time, newest first; a cluster's time is that of its newest member. Returns each item's cluster number and size; items
    without network, fingerprint or time are in no cluster.

    Only the distinct times of a title are put in order. They pass by in batches, and of a title only the last cluster's
    time is kept: times come newest first, so none is near an earlier cluster.
    """
    clustered = F.col("network").isNotNull() & F.col("fingerprint").isNotNull() & F.col("published_at").isNotNull()
    key = ["network", "fingerprint"]
    times = items.filter(clustered).groupBy(*key, "published_at").agg(F.count("*").alias("_n"))
    ordered = times.withColumn(
        "_at", F.unix_micros(F.col("published_at").cast("timestamp"))
    ).repartition(*key).sortWithinPartitions(*key, F.desc("_at"))
    band = hours * 3_600_000_000

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        title, head, k = None, 0, 0
        for b in batches:
            own = []
            for n, f, t in zip(
                b.column("network").to_pylist(), b.column("fingerprint").to_pylist(), b.column("_at").to_pylist(), strict=True
            ):
                if (n, f) != title:
                    title, head, k = (n, f), t, 0
                elif head - t > band:
                    head, k = t, k + 1
                own.append(k)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(own, pa.int64())], names=[*names, "cluster"])

    names = [*key, "published_at", "_n"]
    schema = times.select(*names, F.lit(0).cast("long").alias("cluster")).schema
    numbered = ordered.mapInArrow(number, schema)
    sizes = numbered.groupBy(*key, "cluster").agg(F.sum("_n").alias("size"))
    placed = numbered.drop("_n").join(sizes, [*key, "cluster"])
    out = items.filter(clustered).join(placed, [*key, "published_at"]).select(*key, "external_id", "cluster", "size")
    return out.unionByName(
        items.filter(~clustered).select(*key, "external_id", F.lit(None).cast("long").alias("cluster"), F.lit(1).cast("long").alias("size"))
    )


def next_state(state: tuple, at: int, ok: bool, kind: str | None, reason: str | None, duplicate: bool = False) -> tuple:
    """One step of the breaker: (status, reason, failures, disabled_until, disabled_since) after an attempt; times in
    microseconds. duplicate: another endpoint of the source works."""
    status, why, failures, until, since = state
    if ok:
        return "active", None, 0, None, None
    failures += 1
    if kind == "permanent" or reason == "http_404" and (duplicate or failures >= POLICY["permanent_404_after"]):
        return "disabled_permanent", reason, failures, at + POLICY["permanent_days"] * DAY, since if since is not None else at
    if kind == "temporary" and failures >= POLICY["temporary_after"]:
        return "disabled_temporary", reason, failures, at + POLICY["temporary_days"] * DAY, since if since is not None else at
    if status == "active":
        return status, None, failures, until, since
    if kind is None and (until is None or until <= at):  # it is checked again and still fails
        until = at + POLICY["temporary_days" if status == "disabled_temporary" else "permanent_days"] * DAY
    return status, why, failures, until, since


def breaker_states(attempts: DataFrame) -> DataFrame:
    """(outlet_id, ran_at, id, ok, failure struct, duplicate): the breaker's state of each outlet after all its attempts.

    Only the failures after an outlet's last success matter. What decides is known from windows over these: the last failure
    that disables gives status and reason, the first that does gives disabled_since. Only refreshed dates depend on each other:
    between failures that disable, those that tell nothing move the date whenever it has passed, in a fold over their times.
    """
    order = W.partitionBy("outlet_id").orderBy("ran_at", "id")
    # attempts are read once, and the failures that matter are kept for all that is taken from them
    attempts = stored(attempts.select("outlet_id", "ran_at", "id", "ok", "failure", "duplicate"))
    last = attempts.filter("ok").groupBy("outlet_id").agg(F.max(F.struct("ran_at", "id")).alias("_last"))
    now = F.struct("ran_at", "id")
    failed = stored(
        attempts.join(last, "outlet_id", "left").filter(~F.col("ok") & (F.col("_last").isNull() | (now > F.col("_last")))).drop("_last")
    )
    rows = failed.select(
        "outlet_id", "ran_at", "id", F.col("failure.kind").alias("kind"), F.col("failure.reason").alias("reason"),
        F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.row_number().over(order).alias("_k")
    )
    permanent = (F.col("kind") == "permanent") | (F.col("reason") == "http_404") & (
        F.col("duplicate") | (F.col("_k") >= POLICY["permanent_404_after"])
    )
    status = F.when(permanent, "disabled_permanent").when(
        (F.col("kind") == "temporary") & (F.col("_k") >= POLICY["temporary_after"]), "disabled_temporary"
    )
    rows = rows.withColumn("_status", status).withColumn("_at", F.unix_micros(F.col("ran_at").cast("timestamp")))
    disables = F.col("_status").isNotNull()
    group = rows.withColumn("_from", F.max(F.when(disables, F.col("_k"))).over(order))
    ends = group.groupBy("outlet_id").agg(
        F.max("_k").cast("long").alias("failures"), F.max("_from").alias("_from"),
        F.min(F.when(disables, F.col("ran_at"))).alias("disabled_since")
    )
    later = group.join(ends.select("outlet_id", F.col("_from").alias("_end")), "outlet_id").filter(F.col("_from") == F.col("_end"))
    state = later.groupBy("outlet_id").agg(
        F.max(F.when(disables, F.col("_status"))).alias("status"), F.max(F.when(disables, F.col("reason"))).alias("reason"), F.max(F.when(disables, F.col("_at"))).alias("_start"),
        F.array_sort(F.collect_list(F.when(~disables & F.col("kind").isNull(), F.col("_at")))).alias("_checks"),
    )
    days = F.when(F.col("status") == "disabled_temporary", POLICY["temporary_days"]).otherwise(POLICY["permanent_days"]) * F.lit(DAY)
    moved = F.aggregate(
        "_checks", F.col("_start") + F.col("_days"), lambda until, t: F.when(until <= t, t + F.col("_days")).otherwise(until)
    )
    dated = state.withColumn("_days", days).select("outlet_id", "status", "reason", as_time(moved).alias("disabled_until"))
    none = F.lit(None)
    well = last.join(failed.select("outlet_id").distinct(), "outlet_id", "left_anti").select(
        "outlet_id", F.lit("active").alias("status"), none.cast("string").alias("reason"), F.lit(0).cast("long").alias("failures"),
        none.cast("timestamp_ntz").alias("disabled_until"), none.cast("timestamp_ntz").alias("disabled_since")
    )
    bad = ends.join(dated, "outlet_id", "left").select(
        "outlet_id", F.coalesce("status", F.lit("active")).alias("status"), "reason", "failures", "disabled_until",
        F.col("disabled_since").cast("timestamp_ntz").alias("disabled_since")
    )
    return bad.unionByName(well)


def as_time(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")
