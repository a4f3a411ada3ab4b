"""What must hold of results whatever the data: bounds, sums, idempotence and independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from coverlake.operators import merge
from coverlake.plans import benchmark, coverage, ingest
from coverlake.sources import fixtures as fx
from coverlake.sources.fixtures import AS_OF


def test_benchmark_bounds(spark, sf_dir):
    series = benchmark.daily_series(fx.articles(spark, sf_dir), fx.catalog(spark, sf_dir)).cache()
    assert series.filter("fresh > published or fresh + late <> inserted").count() == 0
    assert series.filter("top1_bps > top5_bps or top5_bps > top10_bps or top10_bps > 10000").count() == 0
    assert series.count() > 10


def test_parity_finds_differences(spark, sf_dir):
    day = benchmark.daily(fx.articles(spark, sf_dir), fx.catalog(spark, sf_dir), "2024-01-19").cache()
    changed = day.withColumn("published", F.when(F.col("country") == "NATION_0", F.col("published") + 1).otherwise(F.col("published")))
    assert benchmark.parity(day, day, ["country"], ["published"]).count() == 0
    found = benchmark.parity(changed, day.filter("country <> 'NATION_1'"), ["country"], ["published", "late"]).collect()
    assert {(r["country"], r["difference"]) for r in found} == {("NATION_0", "published"), ("NATION_1", "missing_counted")}


def test_sources_sum_to_countries(spark, sf_dir):
    a, c = fx.articles(spark, sf_dir), fx.catalog(spark, sf_dir)
    by_source = benchmark.daily_sources(a, c, "2024-01-19").agg(F.sum("published"), F.sum("inserted")).first()
    by_country = benchmark.daily(a, c, "2024-01-19").agg(F.sum("published"), F.sum("inserted")).first()
    assert tuple(by_source) == tuple(by_country)


def test_upsert_twice(spark, sf_dir):
    old, new = ingest.existing(spark, sf_dir), merge.dedupe_batch(ingest.incoming(spark, sf_dir)).drop("seq")
    once = merge.upsert(old, new).cache()
    keys = ["external_id", "title_original", "title_quality", "topics", "feed_categories", "created_at"]
    assert once.count() == once.select("external_id").distinct().count()
    assert merge.upsert(once, new).select(keys).exceptAll(once.select(keys)).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_partitioning_does_not_matter(spark, sf_dir, n):
    a, c = fx.articles(spark, sf_dir), fx.catalog(spark, sf_dir)
    m = coverage.source_metrics(a, AS_OF, "24h")
    want = sorted(map(tuple, coverage.publishers(m, c).collect()))
    dealt = coverage.source_metrics(a.repartition(n, F.rand(3)), AS_OF, "24h")
    assert sorted(map(tuple, coverage.publishers(dealt, c).collect())) == want


def test_publishers_dedupe(spark, sf_dir):
    m, c = coverage.source_metrics(fx.articles(spark, sf_dir), AS_OF, "7d"), fx.catalog(spark, sf_dir)
    many = {r["name"]: r["active_sources"] for r in coverage.publishers(m, c, "7d").collect()}
    once = {r["name"]: r["active_sources"] for r in coverage.publishers(m, c, "7d", dedupe_sources=True).collect()}
    assert all(once[k] <= many[k] for k in many) and sum(once.values()) < sum(many.values())


def test_jitter(spark):
    a, b = coverage.coordinate_jitter(F.col("k"))
    rows = spark.createDataFrame([("x",), ("y",), ("x",)], "k string").select(a, b).collect()
    assert rows[0] == rows[2] != rows[1] and all(abs(v) <= 0.35 for r in rows for v in r)


def nodes(plan):
    """All operators of a physical plan, those behind adaptive execution too."""
    yield plan
    inner = plan.inputPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else None
    if inner is not None:
        yield from nodes(inner)
    children = plan.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def windows_over_everything(df):
    plan = df._jdf.queryExecution().executedPlan()
    return [n.toString() for n in nodes(plan) if n.getClass().getSimpleName() == "WindowExec" and n.partitionSpec().isEmpty()]


def test_the_check_for_windows_can_fail(spark):
    from pyspark.sql import Window as W

    rows = spark.range(10)
    assert len(windows_over_everything(rows.withColumn("n", F.row_number().over(W.orderBy("id"))))) == 1
    assert windows_over_everything(rows.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("id")))) == []


#: Rules, addresses, pages and bytes that Column expressions cannot read.
PYTHON = {
    "a30_greedy_lift", "m02_syndication_clusters", "sc02_catalog_file", "sc03_feed_items", "sc04_sitemap_entries", "sc05_list_pages",
    "sc06_sitemap_children", "sc09_landed_bytes", "x01_addresses", "x_text_values"
}
RULES = {
    "x25_hybrid_rules", "x37_publisher_rules", "x26_keyword_lists", "x31_context_rules", "f15_address_rules", "x29_topic_rules",
    "x34_place_rules"
}
#: A window over one row for each window and version.
ONE_ROW = {"q36_map_metrics"}


def test_plans_have_no_python_and_no_single_partition_windows(spark, sf_dir):
    from coverlake.plans import registry

    for name, query in registry.QUERIES.items():
        df = query(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert name in PYTHON | RULES or not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
        assert "CartesianProduct" not in plan, name
        # a window over everything sorts all rows in one task
        assert name in ONE_ROW or not windows_over_everything(df), name
