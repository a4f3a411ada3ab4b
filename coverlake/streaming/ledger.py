"""Counters that add up batches, each once however often it runs, beside the rows they were counted from.

A table is a folder: ``rows/batch=N`` holds a batch's rows, ``sums/batch=N`` its sums by key, ``ledger/batch=N`` says that both
are whole, and ``base/upto=N`` holds the sums of all batches to N. A batch that runs again writes its own folders anew; one that
the base holds already is passed over. Readers take the latest whole base and the batches after it that the ledger names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The N of all folders ``name=N`` within that a job has finished."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def upto(spark: SparkSession, path: str) -> int:
    return max(numbers(spark, f"{path}/base", "upto"), default=-1)


def append(rows: DataFrame, path: str, batch: int, keys: list[str], counters: list[str]) -> bool:
    """Write a batch's rows and sums; False if the base holds it already."""
    spark = rows.sparkSession
    if batch <= upto(spark, path):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    landed = spark.read.schema(rows.schema).parquet(f"{path}/rows/batch={batch}")  # what is counted is what was written
    landed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]).write.mode("overwrite").parquet(f"{path}/sums/batch={batch}")
    spark.range(1).select(
        F.lit(batch).alias("batch"), F.current_timestamp().alias("written_at")
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")
    return True


def sink(path: str, keys: list[str], counters: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function."""

    def run(batch: DataFrame, number: int) -> None:
        append(batch, path, number, keys, counters)

    return run


def read_sums(spark: SparkSession, path: str, keys: list[str], counters: list[str]) -> DataFrame | None:
    """Sums by key over all batches of the ledger; None before the first."""
    base = upto(spark, path)
    parts = [f"{path}/base/upto={base}"] if base >= 0 else []
    parts += [f"{path}/sums/batch={n}" for n in numbers(spark, f"{path}/ledger", "batch") if n > base]
    if not parts:
        return None
    return spark.read.parquet(*parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches of the ledger."""
    found = numbers(spark, f"{path}/ledger", "batch")
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={n}" for n in found]) if found else None


def compact(spark: SparkSession, path: str, keys: list[str], counters: list[str]) -> int:
    """Add all batches so far to the base; the number of the last. Sums of batches stay until the next time, for readers."""
    found = numbers(spark, f"{path}/ledger", "batch")
    last, before = max(found, default=-1), upto(spark, path)
    if last > before:
        read_sums(spark, path, keys, counters).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    return last
