"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import delete, kept, scope, shared_dir, stored

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """The rows of df as one struct column, so that no name of theirs can clash with those an operator adds."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column], name: str = "_row") -> DataFrame:
    """The columns again, then the added ones; an input column with the name of an added one gives way to it."""
    kept = [F.col(name)[c].alias(c) for c in columns if c not in added]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])


def joined_back(
    rows: DataFrame, per_key: DataFrame, key: str, sizes: DataFrame, how: str = "inner", *, share: int = 256, places: int = 32
) -> DataFrame:
    """rows with the columns of per_key, which has one row for each key at most. sizes: the key and _n, how many rows carry it.

    Keys with over one in ``share`` of all rows, of which there are fewer than ``share``, are named in the plan; their rows are
    dealt to several places, each with a copy of what per_key has for them.
    """
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in sizes.filter(F.col("_n") * share > total).filter("_n > 1").select(key).collect()]
    if not hot:
        return rows.join(per_key, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = rows.withColumn("_place", F.when(is_hot, F.monotonically_increasing_id() % places).otherwise(0).cast("int"))
    copied = per_key.select(
        "*", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(places - 1))).otherwise(F.array(F.lit(0)))).alias("_place")
    )
    return dealt.join(copied, [key, "_place"], how).drop("_place")


__all__ = ["WORD", "delete", "joined_back", "kept", "packed", "scope", "shared_dir", "stored", "table", "unpacked"]
