"""Dossiers of persons: how well their fields are covered, which to work on first, and an editorial overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import fixtures as fx

#: Caps and weights of the seed score and of the priority.
CAPS = {"official": (5, 28), "reported": (4, 26)}
RUMOR = (2, 3, 14)
PRESTIGE = {"first": 26, "second": 14}
FIELDS = ["birth", "club", "position", "biography", "social"]


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons for the fixtures: one for each customer, with what their orders stand for."""
    c, o = fx.load(spark, sf_dir, "customer"), fx.load(spark, sf_dir, "orders")
    counts = o.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("official"), F.count_if(F.col("o_orderstatus") == "O").alias("reported"),
        F.count_if(F.col("o_orderstatus") == "P").alias("rumor")
    )
    rows = c.join(counts, c["c_custkey"] == counts["o_custkey"], "left").na.fill(0, ["official", "reported", "rumor"])
    return rows.selectExpr(
        "c_custkey person_id", "c_name name", "c_mktsegment team", "official", "reported", "rumor", "c_custkey % 4 controversy", "c_custkey % 11 = 0 captain",
        "case c_custkey % 5 when 0 then 'first' when 1 then 'second' else 'other' end prestige", "cast(floor(abs(c_acctbal) * 100) as long) followers", "c_custkey % 7 human_interest",
        "if(c_custkey % 2 = 0, '1990', null) birth", "if(c_custkey % 3 = 0, '', c_mktsegment) club", "if(c_custkey % 5 = 0, null, 'P') position", "if(c_custkey % 3 = 1, null, 'text') biography", "if(c_custkey % 4 = 0, '@x', null) social",
    )


def filled(name: str) -> Column:
    return F.coalesce(F.trim(name) != "", F.lit(False))


def missing() -> Column:
    return sum(((~filled(f)).cast("int") for f in FIELDS), F.lit(0))


def coverage(people: DataFrame) -> DataFrame:
    """Share of filled fields of each team, rounded percent, and by field."""
    n = F.count("*")
    return people.groupBy("team").agg(
        n.alias("persons"), *[F.count_if(filled(f)).alias(f) for f in FIELDS],
        F.round(100 * F.sum(F.lit(len(FIELDS)) - missing()) / (n * len(FIELDS))).cast("long").alias("percent")
    )


def seed() -> Column:
    capped = lambda c: F.least(F.lit(CAPS[c][1]), CAPS[c][0] * F.col(c))
    follower = F.when(
        F.col("followers") > 0, 4 + F.least(F.lit(36), F.round(6 * F.log10(F.col("followers") + 10)).cast("long"))
    ).otherwise(0)
    prestige = F.when(F.col("prestige") == "first", PRESTIGE["first"]).when(F.col("prestige") == "second", PRESTIGE["second"]).otherwise(0)
    return F.col("human_interest") + capped("official") + capped("reported") + F.least(
        F.lit(RUMOR[2]), RUMOR[0] * F.col("rumor") + RUMOR[1] * F.col("controversy")
    ) + F.when(F.col("captain"), 10).otherwise(0) + prestige + follower + F.when(filled("biography"), 6).otherwise(0)


def priorities(people: DataFrame, k: int = 10) -> DataFrame:
    """The first k persons of each team by priority: the seed, a bonus for known teams, the gap to the team's best, what is missing."""
    rows = people.withColumn("seed", seed().cast("long"))
    best = rows.groupBy("team").agg(F.max("seed").alias("_best"))
    joined = rows.join(best, "team")
    priority = F.col("seed") + F.when(F.col("prestige") == "first", 22).otherwise(10) + F.floor(
        0.55 * (F.col("_best") - F.col("seed")) + 0.5
    ) + 2 * missing() + F.when(filled("biography"), 0).otherwise(32)
    ranked = joined.withColumn("priority", priority.cast("long")).withColumn(
        "rank", F.row_number().over(W.partitionBy("team").orderBy(F.desc("priority"), F.asc("person_id"))).cast("long")
    )
    return ranked.filter(F.col("rank") <= k).select("team", "rank", "person_id", "seed", "priority")


def overlay(people: DataFrame, edits: DataFrame) -> DataFrame:
    """Cards with editors' values before stored ones; edits: person_id, biography, hidden. Hidden cards go."""
    joined = people.select("person_id", "name", "team", "biography").join(
        edits.select("person_id", F.col("biography").alias("_new"), "hidden"), "person_id", "left"
    )
    return joined.filter(~F.coalesce("hidden", F.lit(False))).select(
        "person_id", "name", "team", F.coalesce(F.nullif(F.trim("_new"), F.lit("")), "biography").alias("biography"),
        F.col("hidden").isNotNull().alias("edited")
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits for the fixtures: one for each supplier."""
    return fx.load(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey * 3 person_id", "if(s_suppkey % 2 = 0, s_name, ' ') biography", "s_suppkey % 9 = 0 hidden"
    )


def display_name(name: Column) -> Column:
    """A name without bracketed notes and with single spaces; "Last, First" turned round."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*[(\[][^)\]]*[)\]]", ""), r"\s+", " "))
    return F.regexp_replace(clean, r"^([^,]+), ([^,]+)$", "$2 $1")
