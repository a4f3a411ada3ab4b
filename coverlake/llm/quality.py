"""Quality rules as a learned decision list.

Statistics of each text are Spark expressions: words, characters in words, symbols, repeated lines, and the words that lie in
windows of eight words found twice or more. Sequential covering learns an ordered list of conjunctions of thresholds from the
statistics of labelled documents: each rule grows by the threshold with the best information gain, is pruned from its end on
held-back rows, and the rows it covers go. The list becomes one ordered conditional expression.

Scale: one scan, no shuffle: all statistics are functions of one row. Learning reads the rows of at most ``fit_rows`` labelled
documents (those with the smallest digests of their ids), which bounds what comes to the driver and what is broadcast.

Edge cases: null text has no words and fails the base rules; null labels and labels without a document are left out; with no
usable labels the list is empty and keeps all that passes the base rules; a document labelled twice counts twice; an empty
table gives an empty table; input columns named like the statistics give way to them. Repeated rows are judged each, alike; texts
of any length are counted whole. Of conditions with equal gain the first grows the rule, in order of statistics, then of
thresholds from below, then "at least" before "under".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, unpacked

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules test: SQL over the statistics.
RATIOS = {
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_lines_per_100_words": "100.0D * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    columns = docs.columns
    at = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text")
    )
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    one = at.select("_row", "_text", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    two = one.select(
        "_row", *[v.cast("long").alias(k) for k, v in counts.items()], F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1")
    )
    # each step in a select of its own: an array that two expressions need is then made once
    for width in (1, 2, 4):
        rest = F.slice(f"_h{width}", width + 1, F.greatest(F.size(f"_h{width}"), F.lit(1)))
        two = two.select("_row", *counts, F.zip_with(f"_h{width}", rest, lambda a, b: F.xxhash64(a, b)).alias(f"_h{2 * width}"))
    three = two.select(
        "_row", *counts,
        F.when(
            F.col("n_words") > WINDOW, F.slice("_h8", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0)))
        ).alias("_win")
    )
    four = three.select(
        "_row", *counts,
        F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"),
            F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("_sorted")
    )
    # windows beside an equal one in the sorted order are those found twice or more
    n = F.size("_sorted")
    after = F.slice("_sorted", 2, F.greatest(n, F.lit(1)))
    five = four.select(
        "_row", *counts, "_sorted",
        F.when(
            F.col("_sorted").isNotNull(), F.zip_with("_sorted", after, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        ).alias("_same")
    )
    before = F.concat(F.array(F.lit(False)), F.slice("_same", 1, F.greatest(n - 1, F.lit(0))))
    marked = F.zip_with("_sorted", F.zip_with("_same", before, lambda a, b: a | b), lambda s, twice: F.when(twice, s["i"]))
    six = five.select(
        "_row", *counts, F.when(F.col("_sorted").isNotNull(), F.array_sort(F.filter(marked, lambda i: i.isNotNull()))).alias("_at")
    )
    # a window adds its eight words, less those that the next one begins with
    steps = F.zip_with(
        "_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))
    )
    covered = F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)).cast("long")
    # as the output of a generator the statistics are made once: a later filter on them does not move below
    made = six.select("_row", F.explode(F.array(F.struct(*counts, covered.alias("n_repeat_words")))).alias("_s"))
    return unpacked(made, columns, {c: F.col(f"_s.{c}") for c in STATISTICS})


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


@dataclass(frozen=True)
class Rule:
    """Reject where every (ratio, is at least, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.tests:
            out = out & (F.expr(RATIOS[name]) >= threshold if at_least else F.expr(RATIOS[name]) < threshold)
        return out


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_tests: int = 3, min_precision: float = 0.97,
    min_covered: int = 20, cuts: int = 64
) -> list[Rule]:
    """Sequential covering: grow on two thirds of the rows, prune on the rest, keep rules that hold on both."""
    rules: list[Rule] = []
    grow = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), dtype=bool)
    grid = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts))) if len(v) else v for k, v in x.items()}
    # between two values that occur lies the threshold
    grid = {k: (v[1:] + v[:-1]) / 2 for k, v in grid.items()}

    def holds(tests: tuple, rows: np.ndarray) -> np.ndarray:
        for name, at_least, t in tests:
            rows = rows & ((x[name] >= t) if at_least else (x[name] < t))
        return rows

    def precision(rows: np.ndarray) -> float:
        return bad[rows].mean() if rows.any() else 0.0

    while len(rules) < max_rules and bad[left & grow].any():
        tests: tuple = ()
        rows = left & grow
        while len(tests) < max_tests and precision(rows) < 1:
            p0 = np.log2(max(precision(rows), 1e-9))
            best, gain = None, 0.0
            for name, values in x.items():
                for t in grid[name]:
                    for at_least in (True, False):
                        covered = rows & ((values >= t) if at_least else (values < t))
                        n, p = covered.sum(), (covered & bad).sum()
                        if p and n >= min_covered and (g := p * (np.log2(p / n) - p0)) > gain + 1e-9:
                            best, gain = (name, at_least, float(t)), g
            if best is None:
                break
            tests, rows = (*tests, best), holds((best,), rows)
        worth = lambda t: (lambda r: (2 * (r & bad).sum() - r.sum()) / max(r.sum(), 1))(holds(t, left & ~grow))
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        covered = holds(tests, left)
        held = holds(tests, left & ~grow)
        if not tests or covered.sum() < min_covered or min(precision(covered), precision(held)) < min_precision:
            break
        rules.append(Rule(tests))
        left &= ~covered
    return rules


def fit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 12_000, **how
) -> list[Rule]:
    """Learn the list from at most fit_rows labelled documents; label 0 is bad. Rows that fail the base rules teach nothing."""
    usable = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).dropna()
    some = usable.orderBy(F.xxhash64("_key"), "_key", "_label").limit(fit_rows)
    # at most fit_rows ids, so the broadcast is bounded
    mine = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = statistics(mine.join(F.broadcast(some), "_key"), "_text").filter(~base_failed())
    seen = rows.orderBy(F.xxhash64("_key"), "_key", "_label", *STATISTICS).select(
        "_label", *[F.expr(v).alias(k) for k, v in RATIOS.items()]
    ).limit(fit_rows).collect()
    x = {k: np.array([r[k] for r in seen], dtype=float) for k in RATIOS}
    return learn(x, np.array([r["_label"] == 0 for r in seen], dtype=bool), **how)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].condition(), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All columns of docs, the statistics, base_failed, rule (0: none) and kept."""
    rows = statistics(docs, text)
    names = [c for c in rows.columns if c not in ("base_failed", "rule", "kept")]
    rows = rows.select(*[rows[f"`{c}`"] for c in names], base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return rows.select("*", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
