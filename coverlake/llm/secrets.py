"""Secret scans with corpus-wide ownership frequency.

Each text gives candidate spans: assigned values, access keys, hex runs, vendor formats and opaque runs. The values' digests
are then counted over the whole corpus by distinct owners and by distinct repositories. A value that many owners carry is a
copied example; one that few owners carry looks live. Opaque runs count only where the same value is assigned to a
secret's name somewhere in the corpus and looks live: these spans no pattern on a single text can find.

Scale: a cheap test of what every span needs tells which rows can have any; the others pass through without a shuffle. Rows that
can are stored with their spans. Counts go through (value, owner, repository), then (value, owner), then value, each combined
before its shuffle, so a value that a third of all rows carry is no hot group. Verdicts return to the stored rows by the digest
of the text; a text that many rows carry meets them in several places.

Edge cases: null text is empty; null owner and null repository count as one owner or repository each; equal texts have equal
spans; overlapping spans of different kinds all stay; an empty table gives an empty table; an input column named ``spans``
gives way to the result. Repeated rows each have their spans and count as one document of their id; texts of any length are
searched whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_back, stored, unpacked

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: (kind, pattern, group that is the value, least characters of the value, does the value need a digit)
KINDS = [
    ("assign", ASSIGN, 2, 12, False), ("access", ACCESS, 0, 18, False), ("hex", HEX, 0, 16, False), ("vendor", VENDOR, 0, 1, False),
    ("opaque", OPAQUE, 0, 20, True)
]
#: Every match of a kind holds one of these: a name in any case, a mark, or a run; that of an opaque value has a digit.
NAMES, MARKS = ["passw", "secret", "token", "apikey", "api_key"], [
    "AKIA", "AIza", "xox", "eyJ", "_live_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "-----BEGIN"
]
HEX_RUN, RUN = r"[0-9a-f]{16}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def found(text: Column, rank: int) -> Column:
    """Spans of one kind. Splitting at the pattern gives what lies between the matches, and so where each one starts."""
    kind, pattern, group, least, digit = KINDS[rank]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))),
        values, lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        good = s["size"].isNotNull() & (F.length(s["value"]) >= least)
        good = good & s["value"].rlike("[0-9]") & s["value"].rlike("[A-Zg-z]") if digit else good
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), (begin + s["size"]).alias("end"), F.lit(kind).alias("kind"),
            s["value"].alias("value")
        )
        return F.struct(
            (begin + F.coalesce(s["size"], F.lit(0))).alias("at"),
            F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPAN).alias("spans")
        )

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def may_hold(text: Column) -> Column:
    """Whether a text can have any span; true of few texts without one, and much cheaper to find out."""
    named = F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [low.contains(x) for x in NAMES]))  # in lower case once
    return named | reduce(or_, [text.contains(x) for x in MARKS]) | text.rlike(HEX_RUN) | text.rlike("[0-9]") & text.rlike(RUN)


def scan(
    docs: DataFrame, *, text: str = "text", owner: str = "source", repository: str = "doc_id", example_owners: int = 3,
    example_repositories: int = 5
) -> DataFrame:
    """All columns of docs, then spans: array of (start, rank, end, kind, value, owners, repositories, live), by start and kind.

    Offsets are in code points, the end is exclusive. A value is a copied example if at least example_owners owners and
    example_repositories repositories carry it, or if it has under five different characters.
    """
    columns = docs.columns
    keyed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"),
        docs[owner].cast("string").alias("_owner"), docs[repository].cast("string").alias("_repo")
    )
    can = may_hold(F.col("_text"))
    each = keyed.filter(can).select(
        "_row", F.md5("_text").alias("_key"), "_owner", "_repo",
        F.concat(*[found(F.col("_text"), k) for k in range(len(KINDS))]).alias("_spans")
    )
    rows = stored(each)
    # what repeats of one text by one owner and repository add is only their number
    each = rows.filter(F.size("_spans") > 0)
    value = F.xxhash64(F.col("_s.value"))
    seen = each.select("_owner", "_repo", F.explode("_spans").alias("_s")).groupBy(value.alias("_v"), "_owner", "_repo").agg(
        F.max((F.col("_s.kind") == "assign").cast("int")).alias("_named")
    )
    by_owner = seen.groupBy("_v", "_owner").agg(F.count("*").alias("_r"), F.max("_named").alias("_named"))
    counts = by_owner.groupBy("_v").agg(F.count("*").alias("_owners"), F.sum("_r").alias("_repos"), F.max("_named").alias("_named"))
    texts = each.groupBy("_key").agg(F.first("_spans").alias("_spans"))
    spans = texts.select("_key", F.explode("_spans").alias("_s")).withColumn("_v", value).join(counts, "_v")
    varied = F.size(F.array_distinct(F.split(F.lower("_s.value"), ""))) >= 5
    live = ~((F.col("_owners") >= example_owners) & (F.col("_repos") >= example_repositories)) & varied
    judged = spans.withColumn("_live", live).filter((F.col("_s.kind") != "opaque") | ((F.col("_named") == 1) & F.col("_live")))
    span = F.struct(
        F.col("_s.start").alias("start"), F.col("_s.rank").alias("rank"), F.col("_s.end").alias("end"), F.col("_s.kind").alias("kind"),
        F.col("_s.value").alias("value"), F.col("_owners").alias("owners"), F.col("_repos").alias("repositories"),
        F.col("_live").alias("live")
    )
    verdicts = stored(judged.groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("_verdicts")))
    none = F.array().cast(verdicts.schema["_verdicts"].dataType)
    back = joined_back(
        rows.select("_row", "_key"), verdicts, "_key", rows.groupBy("_key").agg(F.count("*").alias("_n")), "left"
    ).select("_row", "_verdicts")
    out = keyed.filter(~can).select("_row", none.alias("_verdicts")).unionByName(back)
    return unpacked(out, columns, {"spans": F.coalesce("_verdicts", none)})


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every live span replaced by the mark; overlapping spans share one mark, examples stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out")
        )

    live = F.filter(spans, lambda s: s["live"])
    masked = F.aggregate(live, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(live) > 0, masked).otherwise(text)
