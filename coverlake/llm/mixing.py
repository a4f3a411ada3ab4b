"""Mixing sources to target weights by systematic sampling.

Within a source, the documents stand in a fixed order (size class, a slice of the id's digest, size, digest). Each
document is due ``target / source_size`` copies; the running sum of those, moved by one random offset per source, is
cut at whole numbers: a document is emitted once for each whole number its interval crosses. As neighbours in the order have
like sizes, the words taken come near the target.

Scale: one pass sums sizes by (source, size class, slice); all that concerns a whole source runs on these sums. The rows
themselves are dealt by (source, size class, slice), so a source with a third of all rows is spread over up to 256 slices
of each size class, and the only window over rows is within a slice.

Edge cases: null source is a source of its own, last in order; null size counts as 0; a source whose sizes sum to 0 has
target 0 and emits nothing; rows that are equal in all ordering columns are interchangeable; null ids sort as the empty id;
an empty table gives an empty table; input columns named like the added ones give way to them. Repeated rows are taken one by
one; a text of any length counts with all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, unpacked

#: Copies are counted in units of one thousand-millionth, so that sums are exact and reruns agree.
UNIT = 1_000_000_000


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sums: _null, _source, source_size, one row per source. Adds target and copies (in UNIT).

    Sources by code point, null last, weigh ``weights`` in turn. They share the sum of all sizes by weight; no target is
    above cap times its source's size, and what that leaves over goes to the others by weight. With the sources in the order
    of cap * size / weight, those capped come first, and the level (words per weight) that holds at the end is the largest
    of the levels that hold while the first k are capped.
    """
    order = W.orderBy("_null", "_source")
    every = W.partitionBy()
    by_ratio = W.orderBy("_ratio", "_rank")
    ranked = sums.select("*", F.row_number().over(order).alias("_rank"))
    weighed = ranked.select(
        "*",
        F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("_weight")
    )
    rated = weighed.select("*", (F.lit(cap) * F.col("source_size") / F.col("_weight")).alias("_ratio"))
    level = (
        F.sum("source_size").over(every) - F.coalesce(
            F.sum(F.lit(cap) * F.col("source_size")).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        )
    ) / F.sum("_weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    levels = rated.select("*", level.alias("_level"))
    goal = F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.col("_weight") * F.max("_level").over(every))
    return levels.select("_null", "_source", "source_size", goal.cast("double").alias("target")).withColumn(
        "_copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    )


def mix(
    docs: DataFrame, size: Column | None = None, *, source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3, seed: str = "mix"
) -> DataFrame:
    """All columns of docs, then size, source_size, target and copies (how many times the mix takes the document)."""
    columns = docs.columns
    size = F.coalesce((words(docs["text"]) if size is None else size).cast("long"), F.lit(0))
    keyed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), size.alias("_size"), docs[source].isNull().alias("_null"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("_source"),
        F.md5(F.coalesce(docs[key].cast("string"), F.lit(""))).alias("_md5")
    )
    bits = F.length(F.bin("_size"))
    # the position of the highest bit, then the three highest bits: a class grows with the size
    rows = keyed.select(
        "*", (bits * 8 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 3, 0))")).cast("long").alias("_class"),
        F.substring("_md5", 1, 2).alias("_slice")
    )
    slot = ["_null", "_source", "_class", "_slice"]
    slots = stored(rows.groupBy(*slot).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")))
    sources = targets(slots.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size")), weights, cap)
    before = W.partitionBy("_null", "_source").orderBy("_class", "_slice").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    offset = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_null").cast("string"), F.lit(":"), F.col("_source"))), 1, 12), 16, 10
    ).cast("long") % UNIT
    placed = slots.select(*slot, start.alias("_start")).join(sources, ["_null", "_source"]).select(
        *slot, "_start", "source_size", "target", "_copies", offset.alias("_offset")
    )
    inside = W.partitionBy(*slot).orderBy("_size", "_md5")
    joined = rows.join(placed, slot).select("*", (F.col("_start") + F.row_number().over(inside)).alias("_place"))
    step, move = F.col("_copies").cast("decimal(20,0)"), F.col("_offset").cast("decimal(20,0)")
    due = joined.select(
        "*", (F.col("_place").cast("decimal(18,0)") * step + move).alias("_to"),
        ((F.col("_place") - 1).cast("decimal(18,0)") * step + move).alias("_from")
    )
    return unpacked(
        due, columns,
        {
            "size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"),
            "copies": F.expr(f"(_to div {UNIT}) - (_from div {UNIT})")
        }
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it was taken."""
    return mixed.filter("copies > 0").select(
        *columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    ).select(*columns)


__all__ = ["emit", "mix", "targets", "words"]
