"""Scalar and text functions: expected values follow from the rules, not from our output."""

import datetime

import pytest
from pyspark.sql import functions as F

from coverlake.functions import exprs, scalars, text
from coverlake.plans import benchmark

URLS = {
    "https://Example.COM:443/a/b/?utm_source=x&b=2&a=1#top": "https://example.com/a/b?a=1&b=2",
    "http://example.com:80/": "http://example.com/",
    "http://example.com:8080/x/": "http://example.com:8080/x",
    "https://e.org/p?ref=1&gclid=2&q=a&amp;z=1": "https://e.org/p?q=a&z=1",
    "https://www.bing.com/news/apiclick.aspx?url=https%3A%2F%2Fe.org%2Fstory%2F&c=1": "https://e.org/story",
    "not a url/": "not a url",
    "": "",
}


def values(spark, f, *columns):
    names = [f"c{k}" for k in range(len(columns))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(zip(*columns))], "k long, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("k").select(f(*[F.col(n) for n in names])).collect()]


def test_normalize_url(spark):
    assert values(spark, text.normalize_url, list(URLS)) == list(URLS.values())


def test_feed_id(spark):
    ids, links = ["abc  def", "https://e.org/x/?utm_id=1", " ", "ﬁ"], ["https://E.org/1", "https://e.org/1", "https://e.org", None]
    assert values(spark, text.feed_id, ids, links) == ["feed:e.org:abc def", "feed:e.org:https://e.org/x", "", "feed:fi"]


def test_plain_text(spark):
    assert values(spark, text.plain_text, ["a &amp;amp; b", "x  y", "&lt;b&gt;", None]) == ["a & b", "x y", "<b>", ""]


def test_title_from_link(spark):
    assert values(
        spark, text.title_from_link, ["https://e.org/news/big-storm_hits.html", "https://e.org/2024/05/12", "https://e.org/a-b-id123"]
    ) == ["Big storm hits", "", "A b"]


def test_bad_addresses_and_dates(spark):
    bad = ["http://[bad/x", "https://e.org:99x99/a-story-here", None, ""]
    assert values(spark, text.normalize_url, bad) == ["http://[bad/x", "https://e.org:99x99/a-story-here", "", ""]
    assert values(spark, text.title_from_link, bad) == ["", "", "", ""]
    assert values(spark, text.feed_id, ["x"] * 2, bad[:2]) == ["feed:x", "feed:x"]
    assert [text.loose_moment(x) for x in ("9999999999999999", "-9999999999999999", "0001-01-01T00:00:00+14:00")] == [None] * 3


def test_telling_segments(spark):
    links = {
        "news/index.html": "", "art-12345": "", "story20240101-2": "", "0123456789abcdef0123456789abcdef": "", "cisionabc": "",
        "catalog.aspx": "", "a1234567": "", "mayor_resigns": "Mayor resigns", "mayor": "Mayor", "storm-nid77": "Storm",
        "2024-budget": "2024 budget"
    }
    assert values(spark, text.title_from_link, [f"https://e.org/{x}" for x in links]) == list(links.values())


def test_loose_date():
    at = lambda *x: datetime.datetime(*x, tzinfo=datetime.timezone.utc)
    for raw, want in {
        "2024-01-02": at(2024, 1, 2, 12),
        "1700000000": at(2023, 11, 14, 22, 13, 20),
        "1700000000000": at(2023, 11, 14, 22, 13, 20),
        "Tue, 02 Jan 2024 10:00:00 CET": at(2024, 1, 2, 9),
        "2024-07-02T10:00:00 Europe/Berlin": at(2024, 7, 2, 8),
        "2024-01-02T10:00:00+02:00": at(2024, 1, 2, 8),
        "soon": None,
        "": None,
    }.items():
        assert text.loose_moment(raw) == want, raw


def test_keyword_section(spark):
    got = values(
        spark, text.keyword_section(),
        ["Parliament votes on match rules", "The market falls", "Élection day", "Nothing here", "Prewar house"]
    )
    assert [(r["section"], r["confidence"]) for r in got] == [
        ("politics", 0.84), ("business", 0.72), ("politics", 0.84), ("others", 0.51), ("others", 0.51)
    ]


def test_dates_in_urls(spark):
    urls = ["https://e.org/2024/01/31/x", "https://e.org/x-2023-12-01", "https://e.org/2022_02_30/x", "https://e.org/19", None]
    assert values(spark, scalars.date_in_url, urls) == [datetime.date(2024, 1, 31), datetime.date(2023, 12, 1), None, None, None]


def test_relative_age(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    got = values(spark, lambda c: scalars.relative_age(c, now), ["3 hours ago", " 1  Minute ago", "2 days ago", "yesterday"])
    day = datetime.datetime
    assert got == [day(2024, 1, 10, 9), day(2024, 1, 10, 11, 59), day(2024, 1, 8, 12), None]


def test_fnv(spark):
    def plain(s):
        h = 2166136261
        for u in memoryview(s.encode("utf-16-le")).cast("H"):
            h = ((h ^ u) * 16777619) & 0xFFFFFFFF
        return h

    words = ["a", "feed", "ünï", "a\U0001f600b"]
    assert values(spark, scalars.fnv1a, words) == [plain(w) for w in words]
    assert values(spark, scalars.fnv1a, ["", None]) == [2166136261, 2166136261]
    assert values(spark, lambda c: scalars.base36(c.cast("long")), ["35", "36"]) == ["z", "10"]


def test_display_source(spark):
    names = ["Daily  Post - News Sitemap", "A - B", "X - Y - sitemap feed", "  "]
    assert values(spark, scalars.display_source, names) == ["Daily Post", "A - B", "X", ""]


def test_categories(spark):
    df = spark.createDataFrame([(["  World ", "world", "A  b", "", None],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(scalars.categories(F.col("c"))).collect()] == [["World", "A b"], []]


def test_month_week(spark):
    got = values(spark, lambda c: benchmark.month_week(c.cast("date")), ["2024-01-07", "2024-01-08", "2024-01-31"])
    assert got == [1, 2, 5]


def test_low_signal(spark):
    rows = [
        ("ok", "news", "u", "s"), ("ok", "123456", "u", "s"), ("ok", "http://x", "u", "s"), ("suspect", "Good title here", "u", "s"),
        ("ok", "Good title here", "u", "s"), (" ", None, "u", "s"), ("ok", "full", "u", "Oricon x"), ("ok", "full", "u", "s"),
        ("ok", None, None, "s")
    ]
    df = spark.createDataFrame(rows, "title_quality string, title_original string, url string, source string")
    assert [r[0] for r in df.select(exprs.low_signal()).collect()] == [True, True, True, True, False, False, True, False, True]


def test_handles(spark):
    assert values(
        spark, scalars.handle, ["https://twitter.com/@Foo_1", "@Bar", "instagram.com/baz/", "not a handle"]
    ) == ["foo_1", "bar", "baz", None]


@pytest.mark.parametrize(
    ("status", "error", "want"),
    [
        (410, None, ("permanent", "http_410")), (404, None, ("temporary", "http_404")), (503, None, ("temporary", "http_503")),
        (None, "Timed out", ("temporary", "timeout")), (200, "odd", (None, None))
    ]
)
def test_failure_kind(spark, status, error, want):
    df = spark.createDataFrame([(status, error)], "s int, e string")
    assert tuple(df.select(scalars.failure_kind(F.col("s"), F.col("e")).alias("f")).first()["f"]) == want


def test_display_name(spark):
    from coverlake.plans.dossier import display_name

    assert values(spark, display_name, ["Doe, Jane", "A  B (captain)", "X [1] Y", None]) == ["Jane Doe", "A B", "X Y", ""]


def test_fnv_of_all_planes_is_read_once(spark, sf_dir):
    """Against plain steps; the values of an article share one hash."""
    from coverlake.plans import ingest

    texts = ["", "a", "é", "日本", "a\n b", "\U0001f600", "x\U0001f600é", "\uffff", None, " ", "a" * 300]

    def fnv(text):
        h, data = 2166136261, (text or "").encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
        return h

    rows = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, v string").select("k", scalars.fnv1a(F.col("v")).alias("h"))
    assert {r["k"]: r["h"] for r in rows.collect()} == {k: fnv(v) for k, v in enumerate(texts)}
    plan = ingest.scalar_values(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("2166136261") <= 3
