"""Relational building blocks: latest per key, top-k per group, concentration, mode, run length, ranked pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import share_bps


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order; the order must be total to be reproducible."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rn") -> DataFrame:
    """At most k rows per group; Spark keeps only k per group and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def concentration(
    df: DataFrame, keys: list[str], member: str, count: str, ks: tuple[int, ...] = (1, 5, 10), also: tuple[Column, ...] = ()
) -> DataFrame:
    """Share of the k largest members of each group, in basis points: top1_bps and so on. Other aggregates of the group can
    be taken in the same pass."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(count), F.asc_nulls_last(member))))
    total = F.sum(count)
    return ranked.groupBy(*keys).agg(
        *also, *[share_bps(F.sum(F.when(F.col("_rn") <= k, F.col(count)).otherwise(0)), total).alias(f"top{k}_bps") for k in ks]
    )


def mode(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which comes first in the order."""
    first = df.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    counted = first.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    return latest(counted, keys, F.desc("_n"), F.asc("_at")).select(*keys, value)


def leading_run(df: DataFrame, keys: list[str], good: Column, *order: Column) -> DataFrame:
    """How many rows come before the first good one."""
    seen = df.withColumn("_good", F.sum(good.cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return seen.groupBy(*keys).agg(F.count_if(F.col("_good") == 0).alias("run"))


def with_totals_of(rows: DataFrame, whole: DataFrame, *totals: Column) -> DataFrame:
    """Each row with totals over all of whole: an aggregate and a join with its one row, not a window over everything."""
    return rows.crossJoin(F.broadcast(whole.agg(*totals)))
