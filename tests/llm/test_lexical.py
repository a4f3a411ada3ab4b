"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import pytest

from coverlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    count, length = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    for i, q in asked.items():
        found = []
        for at, (d, c) in enumerate(own):
            n = sum(c.values())
            score = 0
            for t, times in q.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2.0 * count + 2) / (2.0 * df[t] + 1)))
                    score += times * w * (1000000000 * c[t] // (1000 * c[t] + 8 * (100 - 75 + 75 * n * count // length)))
            if score > 0:
                found.append((-score, d is None, d or 0, at))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


LONG = "wide " * 30_000 + "River river RIVER"
DOCS = [
    (1, "the river the mill"), (2, None), (3, ""), (4, "THE River, the MILL!"), (5, LONG), (None, "the river"), (None, "the river"),
    (7, "the river"), (7, "the river"), (8, "ÉTÉ été river\x00mill 42"), (9, "...  \n"), (10, "ſ river's mill")
] + [(100 + k, f"the common word{k % 7} river" if k % 3 else "the common") for k in range(40)]
ITEMS = [
    (0, "The river"), (1, "river river mill"), (2, None), (3, "..."), (4, "ÉTÉ 42 nowhere"), (5, "nowhere"), (6, "word1 common"),
    (6, "mill"), (None, "river")
]


@pytest.mark.parametrize("most_terms", [500_000, 0])
def test_search(spark, most_terms):
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in DOCS], "doc_id long, text string, term string, _at int, score string")
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, rank int")
    for k in (10, 3):
        out = lexical.search(docs, items, k=k, most_terms=most_terms)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, out.collect()), key=repr) == plain(DOCS, ITEMS, k)


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).collect() == []
