"""Phrase collocations against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from coverlake.llm import phrases

SMALL = {c: c + 32 for c in range(65, 91)}


def plain(docs, least, top, nearly=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least}
    out = []
    for lang in n:
        rows = []
        for (x, p), a in found.items():
            if x != lang or len(p) < 2:
                continue
            score, _, left, right = min((2000000 * a // (f[x, p[:k]] + f[x, p[k:]]), k, f[x, p[:k]], f[x, p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(y == lang and len(q) > len(p) and inside(q) and 100 * b >= nearly * a for (y, q), b in found.items()):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed=1, docs=120):
    rng = random.Random(seed)
    words = ["the", "Mill", "river", "of", "ÉTÉ", "old", "日本", "x-1", "a\x1cb", "stone"]
    fixed = ["the old stone mill", "river of été", "Mill\tof the river", "old stone"]
    out = [(None, None), ("en", ""), ("", "the old, stone"), ("und", "the old stone mill")]
    for _ in range(docs):
        text = "".join(
            rng.choice([*words, *fixed]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ": "])
            for _ in range(rng.randint(1, 60))
        )
        out.append((rng.choice(["en", "en", "en", "fr", None]), text))
    return out + [("en", "the river " * 20_000)]


@pytest.mark.parametrize("sizes", [{}, {"WORDS": 5, "KEPT": 50, "BATCH": 300}])
@pytest.mark.parametrize("cells", [1 << 27, 1 << 19])
def test_collocations(spark, monkeypatch, sizes, cells):
    for k, v in sizes.items():
        monkeypatch.setattr(phrases, k, v)
    rows = corpus()
    docs = spark.createDataFrame(
        [(lang, text, "p", 1) for lang, text in rows], "lang string, text string, phrase string, n int"
    ).repartition(3)
    for least, top in ((8, 2000), (30, 5)):
        out = phrases.collocations(docs, least=least, top=top, most_cells=cells)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == plain(rows, least, top)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a", "")], "lang string, text string")).collect() == []


def test_sketch_never_counts_less():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)[rng.integers(0, 3000, 40_000)]
    own = phrases.Sketch(18)
    for part in np.array_split(h, 7):
        own.add(part)
    names, n = np.unique(h, return_counts=True)
    least = np.min([own.count[row][phrases.cells(names, row, 18)] for row in range(phrases.ROWS)], axis=0)
    assert (least >= np.minimum(n, phrases.FULL)).all() and (least == n).mean() > 0.99


def test_products_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "a b", 2, big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big)]
    out = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [tuple(r) for r in out] == [("en", "a b", 2, big, 3 * big, 2 * big, 400_000)]
