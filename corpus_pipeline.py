"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens. Each stage's Parquet is the next one's input.

Rules for all stages: a null text counts as the empty text and stays null where a stage keeps it; null sources are a source of
their own, null ids are kept; texts of any length are taken whole; of rows equal in id and text near-dedup keeps one; an empty
table gives an empty table. Stages take and return the columns of documents; columns beyond these are dropped first, so none can
clash. What a stage stores is deleted when its result is written, and that when the next one's is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm import bpe, mixing, quality, secrets, simhash
from coverlake.llm.common import delete, kept, scope, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    docs = docs.select(*COLUMNS)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id, then the least digest; of equal rows one."""
    docs = docs.select(*COLUMNS)
    key = [F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_md5")]
    groups = simhash.near_duplicates(docs.select(F.struct(*key).alias("key"), "text"), key="key", size=5, similarity=0.8)
    keep = stored(groups.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("_n")).select("key.*", "_n"))
    rows = docs.withColumn("_digest", F.md5(F.coalesce("text", F.lit("")))).join(
        keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_md5"))
    )
    once = rows.filter("_n = 1").select(*COLUMNS)
    if not keep.filter("_n > 1").limit(1).count():
        return once
    return once.unionByName(rows.filter("_n > 1").dropDuplicates(["doc_id", "_digest"]).select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; copied examples stay."""
    clean = secrets.redacted(F.coalesce("text", F.lit("")), F.col("spans"))
    scanned = secrets.scan(docs.select(*COLUMNS)).withColumn("_clean", clean)
    changed = F.exists("spans", lambda s: s["live"])
    return scanned.select(
        "doc_id", F.when(changed, F.col("_clean")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each document of the mix."""
    tokens = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", filter_quality), ("simhash near-dedup", drop_near_duplicates), ("secret scans", mask_secrets),
    ("mixing sources", mix_sources), ("bpe encoding", tokenize)
]

#: The learned rules and the encoding are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with kept() as own:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            with scope():
                docs = stored(stage(spark, docs, sf_dir), -2)
            if k:
                delete([own.pop(-2)])
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
