"""Scalar functions as Column expressions: addresses, titles, dates in addresses, ages, digests, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a breaking headline.
BREAKING = ["breaking", "urgent", "developing", "just in", "ultima hora", "última hora", "urgente", "en vivo", "alert", "flash"]
#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 2166136261, 16777619


def sanitized(c: Column) -> Column:
    """Without control characters but for tab and line ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def truncated(c: Column, most: int) -> Column:
    """Cut by code points, then trimmed."""
    return F.trim(F.substring(sanitized(c), 1, most))


def article_id(url: Column) -> Column:
    return F.sha2(url, 256)


def host(url: Column) -> Column:
    """Lower case, without port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != "")).cast("long")


def date_in_url(url: Column) -> Column:
    """The date in /yyyy/mm/dd, else yyyy-mm-dd, else yyyy_mm_dd."""
    low = F.lower(F.coalesce(url, F.lit("")))
    found = [
        F.nullif(
            F.regexp_replace(F.regexp_extract(low, rf"(20[0-9]{{2}}{s}(?:0[1-9]|1[0-2]){s}(?:[0-2][0-9]|3[01]))", 1), "[/_]", "-"),
            F.lit("")
        )
        for s in ("/", "-", "_")
    ]
    return F.coalesce(*found).try_cast("date")


def relative_age(text: Column, now: Column) -> Column:
    """The moment that "3 hours ago" names."""
    clean = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    n = F.regexp_extract(clean, r"^([0-9]{1,9}) (?:minute|hour|day)s? ago$", 1)
    unit = F.regexp_extract(clean, r"^[0-9]{1,9} (minute|hour|day)s? ago$", 1)
    seconds = n.cast("long") * F.when(unit == "minute", 60).when(unit == "hour", 3600).otherwise(86400)
    return F.when(n != "", now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))


def breaking(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(False)
    for term in BREAKING:
        out = out | low.contains(term)
    return out


def display_source(source: Column) -> Column:
    """Without the part after " - " that names a sitemap."""
    clean = F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", " "))
    cut = F.trim(F.regexp_extract(clean, r"(?i)^(.*?) - .*\bsitemap\b", 1))
    return F.when(cut != "", cut).otherwise(clean)


def categories(values: Column) -> Column:
    """White space collapsed, blanks dropped, the first of those equal but for case kept."""
    clean = F.filter(
        F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))),
        lambda x: x != ""
    )
    return F.aggregate(
        clean, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    )


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of the text, as a long from 0 to 2^32 - 1."""
    whole = F.coalesce(text, F.lit(""))
    step = lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    start = F.lit(FNV_START).cast("long")
    # a character is one unit but for those past the first plane, whose two units are read from bytes
    plain = F.aggregate(F.split(whole, ""), start, lambda h, c: step(h, F.ascii(c).cast("long")))
    units = F.encode(whole, "UTF-16BE")
    codes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(units) / 2 - 1, F.lit(0)).cast("int")),
        lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("long")
    )
    return F.when(whole == "", start).when(whole.rlike(r"[^\x{0}-\x{FFFF}]"), F.aggregate(codes, start, step)).otherwise(plain)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def stable_bucket(text: Column, n: int) -> Column:
    return F.pmod(fnv1a(text), F.lit(n))


def page_title(html: Column) -> Column:
    """og:title, else the title element."""
    og = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)
    return F.coalesce(
        F.nullif(F.trim(og), F.lit("")),
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))
    )


def handle(value: Column) -> Column:
    """A social handle from an address or a name with @, in lower case."""
    clean = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    of_url = F.regexp_extract(clean, r"^(?:https?://)?(?:www\.|m\.)?(?:x|twitter|instagram|tiktok|facebook)\.com/@?([a-z0-9_.]+)", 1)
    bare = F.regexp_extract(clean, r"^@?([a-z0-9_.]{1,50})$", 1)
    return F.nullif(F.coalesce(F.nullif(of_url, F.lit("")), bare), F.lit(""))


def failure_kind(status: Column, error: Column) -> Column:
    """Why an endpoint failed, and for how long: (kind, reason)."""
    text = F.lower(F.coalesce(error, F.lit("")))
    moved = status.isin(301, 308) | text.contains("permanent_moved") | text.contains("moved permanently")
    reason = F.when(status == 410, "http_410").when(moved, "permanent_moved").when((status == 404) | (text == "http_404"), "http_404")
    reason = reason.when(
        status.isin(403, 500, 502, 503, 504), F.concat(F.lit("http_"), status.cast("string"))
    ).when(text.contains("timeout") | text.contains("timed out"), "timeout").when(
        text.contains("network_error") | text.contains("abort"), "network_error"
    )
    kind = F.when((status == 410) | moved, "permanent").when(reason.isNotNull(), "temporary")
    return F.struct(kind.alias("kind"), reason.alias("reason"))
