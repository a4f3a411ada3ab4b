"""Rule tables against a scan of all rules, by both ways."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from coverlake.functions import text
from coverlake.operators import rules
from coverlake.plans import ruled

FIELDS = ("source", "country", "title")


def letter(c):
    return unicodedata.category(c)[0] in "LN"


def meets(kind, text, value):
    if kind == "word":
        spots = [i for i in range(len(text) - len(value) + 1) if text.startswith(value, i)] if value else []
        return any(not (i and letter(text[i - 1])) and not (i + len(value) < len(text) and letter(text[i + len(value)])) for i in spots)
    return {"exact": text == value, "prefix": text.startswith(value), "suffix": text.endswith(value), "part": value in text}[kind]


def scan(texts, table):
    """(rule, strongest kind, values of clause 0) of each rule that holds."""
    by = {}
    for rule, clause, field, kind, value in table:
        if value is not None:
            by.setdefault(rule, {}).setdefault(clause, []).append((field, kind, value))
    out = []
    for rule, clauses in sorted(by.items()):
        met = {c: [(k, v) for f, k, v in own if texts.get(f) is not None and meets(k, texts[f], v)] for c, own in clauses.items()}
        if all(met.values()):
            first = met.get(0, [])
            out.append((rule, min((rules.KINDS.index(k) for k, _ in first), default=0), len({v for _, v in first})))
    return out


def made(rng, n):
    word = lambda: "".join(rng.choice("abcé日1 -") for _ in range(rng.randint(1, 5)))
    table = []
    for rule in range(n):
        for clause in range(rng.choice([1, 1, 2, 3])):
            field = rng.choice(FIELDS)
            for _ in range(rng.randint(1, 3)):
                table.append((rule, clause, field, rng.choice(rules.KINDS), word()))
    table += [
        (n, 0, "title", "part", ""), (n + 1, 0, "title", "exact", ""), (n + 2, 1, "title", "word", ""), (n + 3, 0, "nowhere", "part", "a"),
        (n + 4, 0, "title", "part", None), (n + 5, 0, "title", "part", "a.*b\\E")
    ]
    rng.shuffle(table)
    texts = [tuple(None if rng.random() < 0.1 else "".join(word() for _ in range(rng.randint(0, 6))) for _ in FIELDS) for _ in range(60)]
    return table, [*texts, ("", "", ""), (None, None, None), ("a", "b", "xa.*b\\Ey"), texts[0]]


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
@pytest.mark.parametrize("n", [300, 5000])
def test_against_a_scan(spark, n, most_bytes):
    table, texts = made(random.Random(n), n)
    rows = spark.createDataFrame(
        [(k, *t, "x") for k, t in enumerate(texts)], "id long, source string, country string, title string, rule_name string"
    )
    conditions = spark.createDataFrame(table, rules.SCHEMA)
    fields = {f: F.col(f) for f in FIELDS}
    want = {k: scan(dict(zip(FIELDS, t)), table) for k, t in enumerate(texts)}
    assert sum(map(bool, want.values())) > 10
    first = {r["id"]: (r["rule"], r["matched_by"]) for r in rules.first_rule(rows, conditions, fields, most_bytes=most_bytes).collect()}
    assert first == {k: (own[0][0], rules.KINDS[own[0][1]]) if own else (None, None) for k, own in want.items()}
    every = sorted(
        (r["id"], r["rule"], r["matched_by"], r["n"]) for r in rules.all_rules(rows, conditions, fields, most_bytes=most_bytes).collect()
    )
    assert every == sorted((k, rule, rules.KINDS[kind], count) for k, own in want.items() for rule, kind, count in own)


def test_empty_tables(spark):
    rows = spark.createDataFrame([("a",)], "title string")
    none = spark.createDataFrame([], rules.SCHEMA)
    for most in (1, -1):
        assert [tuple(r) for r in rules.first_rule(rows, none, {"title": F.col("title")}, most_bytes=most).collect()] == [("a", None, None)]
        assert rules.first_rule(rows.limit(0), none, {"title": F.col("title")}, most_bytes=most).collect() == []


def test_rule_file(spark, tmp_path):
    file = tmp_path / "rules.json"
    file.write_text(
        json.dumps(
            [
                {
                    "label": "b", "attributes": {"w": "1"},
                    "clauses": [{"field": "title", "word": ["über uns", "x"]}, {"field": "lang", "exact": ["de"]}]
                },
                {"label": "a", "clauses": [{"field": "title", "part": ["ss"], "prefix": ["q"]}]}
            ]
        )
    )
    table = rules.read_rules(spark, str(file))
    assert [(r["rule"], r["label"], r["attributes"]) for r in table.orderBy("rule").collect()] == [(0, "b", {"w": "1"}), (1, "a", None)]
    assert sorted(map(tuple, rules.conditions(table).collect())) == [
        (0, 0, "title", "word", "x"), (0, 0, "title", "word", "über uns"), (0, 1, "lang", "exact", "de"), (1, 0, "title", "part", "ss"),
        (1, 0, "title", "prefix", "q")
    ]


def test_keywords_fold_and_mind_edges(spark):
    table = ruled.keyword_rules(spark)
    texts = [
        (1, "Nacíón, CIÓN!", "es"), (2, "naciónes", "es"), (3, "cion", "fr"), (4, "Über\n\tihn", "de"), (5, "uberall", "de"),
        (6, "the  HEED", "en"), (7, None, "en"), (8, "50 %%% of", None), (9, "über", None)
    ]
    rows = spark.createDataFrame(texts, "id long, text string, lang string")
    out = {
        r["id"]: (r["section"], r["confidence"]) for r in ruled.keyword_sections(rows, table, key="id", text="text", lang="lang").collect()
    }
    other = ("others", 0.51)
    assert out == {
        1: ("sports", 0.84), 2: other, 3: other, 4: ("business", 0.84), 5: other, 6: ("world", 0.84), 7: other, 8: ("entertainment", 0.72),
        9: other
    }


def test_both_ways_on_queries(spark, sf_dir):
    for plan, table in (
        (ruled.context_sections, ruled.context_rules), (ruled.publishers, ruled.publisher_rules), (ruled.topics, ruled.topic_rules)
    ):
        a, t = ruled.fx.articles(spark, sf_dir).limit(300), table(spark, sf_dir)
        rows = lambda **how: sorted(map(tuple, plan(a, *t, **how).collect()), key=repr)  # noqa: B023, E731
        assert rows() == rows(most_bytes=0)


def test_rules_that_begin_or_end_alike_meet_no_pairs(spark):
    """Classes of equal rules are found, not their members; a value that only begins like a text is not met."""
    rows = spark.createDataFrame([(f"report {k} of k{k % 3}", f"src{k}.example.com") for k in range(200)], "title string, host string")
    table = [(r, 0, "title", "word", f"report {r % 400}") for r in range(4000)] + [(r, 1, "host", "suffix", ".example.com") for r in range(4000)]
    conditions, fields = spark.createDataFrame(table, rules.SCHEMA), {"title": F.col("title"), "host": F.col("host")}
    _, found, members = rules.by_joins(rows, conditions, fields, False)
    assert found.count() == 200 and members.count() == 2000
    assert rules.by_joins(rows, conditions, fields, True)[2].count() == 200
    for most in (0, 32 << 20):
        counts = {(r["rule"], r["n"]): r["rows"] for r in rules.rule_counts(rows, conditions, fields, most_bytes=most).collect()}
        assert counts == {(r, 1): 1 for r in range(4000) if r % 400 < 200}


def test_long_values_by_joins(spark):
    """Values longer than what they are found by, with marks of quoting and at edges."""
    long = "ab" * 20
    table = [(0, 0, "title", "word", long + "\\E.x"), (1, 0, "title", "part", long + "z"), (2, 0, "title", "word", long), (3, 0, "title", "prefix", long + "ab")]
    texts = [f"x {long}\\E.x y", f"{long}z", long, f"{long}abz", f"-{long}-", f"{long}\\E.xy", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, title string")
    got = [
        sorted((r["id"], r["rule"], r["matched_by"], r["n"]) for r in rules.all_rules(rows, spark.createDataFrame(table, rules.SCHEMA), {"title": F.col("title")}, most_bytes=m).collect())
        for m in (0, 32 << 20)
    ]
    assert got[0] == got[1] == sorted((k, rule, rules.KINDS[kind], n) for k, t in enumerate(texts) if t for rule, kind, n in scan({"title": t}, table))


def test_topic_totals_are_those_of_the_pairs(spark, sf_dir):
    a, (labels, conditions) = ruled.fx.articles(spark, sf_dir).limit(200), ruled.topic_rules(spark, sf_dir)
    each = ruled.topics(a, labels, conditions, most_bytes=32 << 20).groupBy("topic").agg(F.count("*").alias("titles"), F.sum("score_percent").alias("points"))
    want = sorted(map(tuple, each.collect()))
    assert want and all(sorted(map(tuple, ruled.topic_totals(a, labels, conditions, most_bytes=m).collect())) == want for m in (0, 32 << 20))


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_folding_is_part_of_the_match(spark, most_bytes):
    """Texts of the fields to fold meet values without accents and in lower case, whatever the way; null stays null."""
    texts = ["Élan  VITAL", "ΣΊΣΥΦΟΣ", "élan", "straße", "ﬁne", "İstanbul", "日本 É", "", None, "plain Élan"]
    rows = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "id long, title string, lang string")
    values = ["elan", "σισυφος", "fine", "strasse", "istanbul", "e", ""]
    table = [(k, 0, "title", "part", v) for k, v in enumerate(values)] + [(9, 0, "lang", "part", "É")]
    found = rules.all_rules(
        rows, spark.createDataFrame(table, rules.SCHEMA), {c: F.col(c) for c in ("title", "lang")}, fold=("title",), most_bytes=most_bytes
    )
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    want = {(k, r) for k, t in enumerate(texts) if t is not None for r, v in enumerate(values) if v in plain(t)}
    want |= {(k, 9) for k, t in enumerate(texts) if t and "É" in t}
    assert {(r["id"], r["rule"]) for r in found.collect()} == want
    assert [r[0] for r in rows.select(text.folded("title")).collect()] == [plain(t or "") for t in texts]


def test_keyword_texts_go_to_one_worker(spark, sf_dir):
    """Not first to one that folds them and sends them back whole."""
    plan = ruled.document_keywords(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1
