"""Ranked lexical search over postings.

Each document becomes postings (term, document, tf, n), dealt into buckets by term, and stored. Items' terms meet the postings
of their buckets, each match is scored in integers, scores are summed by item and document, and a window ranks them. Scores
are those of BM25 with b = 3/4 in fixed point.

Scale: texts are read once, for postings and for the corpus's counts. Only postings of terms that some item has leave the
first stage; a bucket is further cut into ``SLICES`` by document, so that a term in a third of all documents is dealt over
many tasks. Weighed postings are then dealt by document, where the items' terms come to them (by broadcast while there are at
most ``most_terms``, else by Spark's join): the scores of a document are summed where its postings are, and only the best k
of each task meet in the ranking.

Edge cases: a null text has no terms and counts neither as a document; null and repeated document ids are documents of their
own, null ids last among equals; items of equal id are one item with all their terms, items without terms have no rows; texts
of any length are taken whole; equal scores go by document id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: ASCII other than letters and digits to a space, A-Z to small letters.
TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
BUCKETS, SLICES = 64, 8


def terms(texts: DataFrame) -> DataFrame:
    """texts: _id, _text (binary). Then _at (a number for each row), _n (its terms) and _terms (array of term and tf)."""
    schema = texts.select(
        "_id", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_n"),
        F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("tf"))).alias("_terms")
    ).schema
    kind = pa.struct([("term", pa.string()), ("tf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, 256):
                own = b.slice(k, 256)
                counts = [Counter((t.as_py() or b"").translate(TERMS).split()) for t in own.column(1)]
                names = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
                tf = pa.array([n for c in counts for n in c.values()], pa.int32())
                ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([names, tf], fields=list(kind)))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), pa.array(made + k + np.arange(len(counts)), pa.int64()),
                        pa.array([sum(c.values()) for c in counts], pa.int64()), listed
                    ],
                    names=schema.names
                )
            made += b.num_rows

    return texts.mapInArrow(run, schema)


def bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, wanted: DataFrame, *, key: str, text: str) -> DataFrame:
    """(bucket, term, _at, _id, tf, n, first) for the wanted terms (term, _wanted) of all documents, and a row with no term where
    a document has none of them; of each document one row is the first. Stored by bucket."""
    rows = docs.select(docs[f"`{key}`"].alias("_id"), docs[f"`{text}`"].cast("binary").alias("_text"))
    each = terms(rows).filter("_n > 0").select("_id", "_at", "_n", F.posexplode("_terms").alias("_place", "_t")).select(
        "_id", "_at", F.col("_n").alias("n"), F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"),
        (F.col("_place") == 0).alias("first")
    )
    some = each.join(wanted, "term", "left").filter("_wanted or first").withColumn("term", F.when(F.col("_wanted"), F.col("term")))
    dealt = some.select(
        bucket("term").alias("bucket"), "term", "_at", "_id", "tf", "n", "first"
    ).repartition("bucket", F.pmod(F.xxhash64("_at"), F.lit(SLICES)))
    return stored(dealt)


def search(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    k: int = 10, most_terms: int = 500_000
) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: item key, rank (from 1), document key, score."""
    queries = items.select(items[f"`{item_key}`"].alias("_id"), items[f"`{item_text}`"].cast("binary").alias("_text"))
    asked = terms(queries).select(
        F.col("_id").alias("item"), F.explode("_terms").alias("_t")
    ).groupBy("item", F.col("_t.term").alias("term")).agg(F.sum("_t.tf").alias("times"))
    asked = stored(asked)
    few = asked.count() <= most_terms  # rows of at most some hundred bytes
    beside = F.broadcast if few else lambda df: df
    wanted = asked.select("term").distinct().withColumn("_wanted", F.lit(True))
    index = postings(docs, beside(wanted), key=key, text=text)
    total = index.filter("first").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()  # one row
    count, length = int(total[0]), max(int(total[1]), 1)
    found = index.filter("term is not null").select("bucket", "term", "_at", "_id", "tf", "n")
    df = found.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = asked.withColumn("bucket", bucket("term")).join(df, ["bucket", "term"]).select(
        "term", "item", (weight * F.col("times")).alias("weight")
    ).filter("weight > 0")
    weighed = stored(weighed)
    m = f"(25 + ((75L * n * {count}L) div {length}L))"
    dealt = found.select("term", "_at", "_id", F.expr(f"(1000000000L * tf) div (1000L * tf + 8 * {m})").alias("part")).repartition("_at")
    scores = dealt.join(beside(weighed), "term").groupBy("item", "_at", "_id").agg(
        F.sum(F.col("weight") * F.col("part")).alias("score")
    ).filter("score > 0")
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_id"), "_at")))
    return ranked.filter(F.col("rank") <= k).select(F.col("item").alias(item_key), "rank", F.col("_id").alias(key), "score")
