"""Vectorised functions for what Column expressions cannot say: address rules, entities, Unicode folding, loose dates, sections."""

from __future__ import annotations

import html
import re
import unicodedata
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from functools import lru_cache
from urllib.parse import unquote
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import whatwg

#: Parameters that only track, and offsets of zone names.
TRACKING = {
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "ocid", "cmpid", "ref", "output"
}
ZONES = {
    "BST": "+0100", "CET": "+0100", "CEST": "+0200", "EET": "+0200", "EEST": "+0300", "MSD": "+0400", "MSK": "+0300", "WEST": "+0100",
    "WET": "+0000"
}


def parsed(text: str | None) -> whatwg.Url | None:
    try:
        return whatwg.parse(text or "")
    except ValueError:
        return None


def clean_url(link: str | None) -> str:
    """One form of an address: no fragment, tracking or default port; parameters sorted; search redirects unwrapped twice."""
    text = re.sub("&amp;", "&", (link or "").strip(), flags=re.I)
    target = text
    for _ in range(2):
        u = parsed(target)
        if u is None or not ((u.host or "").endswith("bing.com") and "/news/apiclick.aspx" in u.path):
            break
        inner = dict(reversed(whatwg.pairs(u.query))).get("url")
        if not inner or unquote(inner) == target:
            break
        target = re.sub("&amp;", "&", unquote(inner), flags=re.I)
    u = parsed(target)
    if u is None:
        return text.rstrip("/")
    kept = [(k, v) for k, v in whatwg.pairs(u.query) if not k.lower().startswith("utm_") and k.lower() not in TRACKING]
    kept.sort(key=lambda kv: (whatwg.order(kv[0]), whatwg.order(kv[1])))
    u.fragment, u.query = None, whatwg.written(kept) or None
    if u.path != "/" and u.host is not None:
        u.path = u.path.rstrip("/") or "/"
    return str(u)


@F.pandas_udf(T.StringType())
def normalize_url(links: pd.Series) -> pd.Series:
    return links.map(clean_url)


@F.pandas_udf(T.StringType())
def feed_id(ids: pd.Series, links: pd.Series) -> pd.Series:
    """feed:host:id, with ids that are addresses in their one form and others in NFKC, at most 512 characters."""

    def one(value: str | None, link: str | None) -> str:
        text = re.sub("&amp;", "&", (value or "").strip(), flags=re.I)
        if not text:
            return ""
        text = clean_url(text) if re.match("https?://", text, re.I) else " ".join(unicodedata.normalize("NFKC", text).split())[:512]
        u = parsed(clean_url(link)) if link else None
        host = u.host if u else None
        return f"feed:{host}:{text}" if host else f"feed:{text}"

    return pd.Series([one(v, x) for v, x in zip(ids, links, strict=True)])


@F.pandas_udf(T.StringType())
def plain_text(values: pd.Series) -> pd.Series:
    """Entities decoded, up to three times; white space collapsed."""

    def one(v: str | None) -> str:
        v = v or ""
        for _ in range(3):
            after = html.unescape(v)
            if after == v:
                break
            v = after
        return " ".join(v.split())

    return values.map(one)


def fold(text: str | None) -> str:
    """Lower case without accents."""
    if (text := text or "").isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    for mark in filter(unicodedata.combining, set(text)):
        text = text.replace(mark, "")
    return text.lower()


#: Texts that a worker holds as Python strings at a time.
SLICE = 256


@F.arrow_udf(T.StringType())
def folded(values: pa.Array) -> pa.Array:
    """fold() of a column."""
    parts = [pa.array([fold(v.as_py()) for v in values.slice(at, SLICE)], pa.string()) for at in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


#: Path words that name a part of a site, a kind of item, or who numbered it.
PLACES = {"index", "news", "article", "story", "video", "world", "home", "catalog"}
NUMBERED = {"art", "audio", "story", "nid", "id"}


def slug_words(segment: str) -> list[str]:
    """The words of a path segment, without its file ending and a number of the item at its end."""
    name, dot, ending = unquote(segment).rpartition(".")
    if not (dot and ending.isascii() and ending.isalnum() and 2 <= len(ending) <= 6):
        name = unquote(segment)
    words = name.replace("_", "-").split("-")
    if len(words) > 1 and words[-1].lower().rstrip("0123456789") in ("id", "nid"):
        words.pop()
    return [x for w in words for x in w.split()]


def coded(word: str) -> bool:
    """Whether one word of a segment only numbers an item."""
    name = word.rstrip("0123456789")
    digits = len(word) - len(name)
    numbered = not name or name == "a" and digits >= 6 or name in ("art", "audio") and digits > 0 or name == "story" and digits == 8
    return numbered or len(word) == 32 and all(c in "0123456789abcdef" for c in word) or word.startswith("cision") and len(word) > 6


def tells(words: list[str]) -> bool:
    """Whether words of a segment are more than numbers, codes and names of parts of a site."""
    if len(words) == 1:
        word = words[0].lower()
        return not coded(word) and word not in PLACES
    return any(w.isalpha() and w.lower() not in NUMBERED for w in words)


@F.pandas_udf(T.StringType())
def title_from_link(links: pd.Series) -> pd.Series:
    """The words of the last path segment that tells something, as a sentence; empty without one."""

    @lru_cache(maxsize=1 << 12)
    def one(link: str | None) -> str:
        u = parsed(link)
        told = (w for w in map(slug_words, reversed(u.path.split("/") if u else [])) if w and tells(w))
        text = " ".join(next(told, []))
        return text[:1].upper() + text[1:]

    return links.map(one)


def loose_moment(value: str | None) -> datetime | None:
    """A date in any of the forms feeds use, in UTC; a date alone is its noon."""
    text = (value or "").strip()
    if not text:
        return None
    if re.fullmatch(r"-?\d{9,16}", text):
        n = int(text)
        try:
            return datetime.fromtimestamp(n if abs(n) < 10**11 else n / 1000, timezone.utc)
        except (ValueError, OverflowError, OSError):
            return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        text += "T12:00:00Z"
    if m := re.fullmatch(r"(.*\s)([A-Z]{2,5})", text):
        text = m[1] + ZONES.get(m[2], m[2])
    zone = None
    if m := re.fullmatch(r"(.*\S)\s([A-Za-z_]+/[A-Za-z0-9_.+/-]+)", text):
        text, zone = m[1], m[2]
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            out = read(text)
        except (ValueError, TypeError, IndexError):
            continue
        try:
            out = out.replace(tzinfo=ZoneInfo(zone)) if zone else out if out.tzinfo else out.replace(tzinfo=timezone.utc)
        except (KeyError, ValueError, OSError):
            return None
        try:
            return out.astimezone(timezone.utc)
        except OverflowError:  # at the ends of what a date can be
            return None
    return None


@F.pandas_udf(T.TimestampType())
def loose_date(values: pd.Series) -> pd.Series:
    return pd.Series(pd.to_datetime([loose_moment(v) for v in values], utc=True))


#: Ordered rules (section, words); our own small table, a parameter of keyword_section.
HIGH = [
    ("conflicts", "war ceasefire airstrike missile"), ("politics", "election parliament senate minister"),
    ("business", "shares inflation bank merger"), ("sports", "match league coach tournament"), ("health", "hospital vaccine virus"),
    ("tech", "software startup robot"), ("climate", "emissions drought wildfire"), ("science", "telescope physicist genome")
]
MEDIUM = [
    ("business", "market economy"), ("politics", "government vote"), ("entertainment", "film album"), ("arts", "museum painting"),
    ("lifestyle", "recipe travel"), ("world", "summit border")
]


def keyword_section(high: list = HIGH, medium: list = MEDIUM):
    """A function title -> (section, confidence, reason): the first high rule, else the first medium one, else others."""
    rules = [
        (s, re.compile(rf"(?<!\w)(?:{'|'.join(w.split())})(?!\w)"), c, why)
        for table, c, why in ((high, 0.84, "high"), (medium, 0.72, "medium")) for s, w in table
    ]

    @F.pandas_udf(
        T.StructType(
            [T.StructField("section", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType())]
        )
    )
    def classify(titles: pd.Series) -> pd.DataFrame:
        def one(title: str | None) -> tuple[str, float, str]:
            low = "".join(c for c in unicodedata.normalize("NFKD", title or "") if not unicodedata.combining(c)).lower()
            return next(((s, c, why) for s, p, c, why in rules if p.search(low)), ("others", 0.51, "none"))

        return pd.DataFrame([one(t) for t in titles], columns=["section", "confidence", "reason"])

    return classify


@F.pandas_udf(T.StringType())
def dedupe_text(values: pd.Series) -> pd.Series:
    """Letters a-z and digits in lower case, without accents, and single spaces for all else."""
    plain = values.fillna("").str.normalize("NFKD").str.replace(r"[\u0300-\u036f]", "", regex=True)
    return plain.str.replace(r"[^a-zA-Z0-9]+", " ", regex=True).str.strip().str.lower()
