"""Column expressions with the engine's cross-cutting meanings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The thirteen sections, in the order that decides ties.
SECTIONS = [
    "world", "politics", "conflicts", "business", "tech", "sports", "health", "entertainment", "lifestyle", "arts", "science", "climate",
    "others"
]


def blank_to(c: Column | str, default: str | None = None) -> Column:
    """Blank counts as null; null becomes the default."""
    c = F.col(c) if isinstance(c, str) else c
    known = F.nullif(F.trim(c), F.lit(""))
    return known if default is None else F.coalesce(known, F.lit(default))


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def before(moment: str, interval: str) -> Column:
    return at(moment) - F.expr(f"interval {interval}")


def visible(quality: str = "title_quality") -> Column:
    return blank_to(quality, "ok") != "suspect"


#: Titles that say nothing, as whole-title patterns, some for sources of a name only.
LOW_SIGNAL = [
    (None, r"^(c[0-9]+\s+[0-9]+(?:\.html)?|art[- ]?[0-9]+(?:\.html)?|story[0-9]{8}(?:[-_ ]?[0-9]+)?(?:\.html)?|[0-9]{6,}|news|latest|domestic|international|photo|video)$"),
    (None, r"^[0-9a-f]{32}$"),
    (None, r"^Cision\p{Alnum}+$"),
    (None, r"^Catalog(?:\.aspx)?(?:\?.+)?$"),
    ("oricon", r"^(full|news|anime|comic|voiceactor)$"),
    ("abema times", r"^(full|news|anime)$"),
    ("parapolitika", r"^[a-z0-9_-]{4,180}$"),
]


def low_signal() -> Column:
    """The title is made once, as the argument of a function, for it may be an expression itself. One pattern serves all titles;
    those of a source alone are tried on its own titles only."""
    every = "|".join(f"(?:{p})" for source, p in LOW_SIGNAL if source is None)

    def dull(title: Column) -> Column:
        out = (title == F.coalesce("url", F.lit(""))) | title.ilike("http%") | title.rlike(f"(?i){every}")
        for source, pattern in LOW_SIGNAL:
            if source is not None:
                out = out | F.coalesce(F.col("source").ilike(f"%{source}%"), F.lit(False)) & title.rlike(f"(?i){pattern}")
        return out

    return ~visible() | F.exists(F.array(F.coalesce("title_original", F.lit(""))), lambda t: dull(F.trim(t)))


def share_bps(part: Column, whole: Column) -> Column:
    """Basis points, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 10000 / whole + 0.5)).otherwise(0).cast("long")


def section_of(c: Column) -> Column:
    """Unknown sections are others."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(SECTIONS), low).otherwise("others")


def source_key(c: Column | str) -> Column:
    """Display name without a sitemap suffix, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, r"(?i)\s+-\s+[^-]*sitemap.*$", "")))


def within(c: Column | str, start: Column, end: Column) -> Column:
    """Half open."""
    c = F.col(c) if isinstance(c, str) else c
    return (c >= start) & (c < end)


def percent(n: Column, d: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * n / F.nullif(d, F.lit(0)), digits)


def health(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("healthy", "warning", "degraded", "failing"), low).otherwise("unknown")


def health_rank(c: Column) -> Column:
    out = F.lit(4)
    for k, name in enumerate(("healthy", "warning", "degraded", "failing")):
        out = F.when(c == name, k).otherwise(out)
    return out
