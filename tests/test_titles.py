"""Like titles against all pairs."""

import random

import pytest

from coverlake.plans import audit


def made():
    rng = random.Random(7)
    own = {
        (f"h{rng.randrange(3)}", tuple(sorted(rng.sample("abcdefghijkl", rng.randint(1, 8)))), rng.random() < 0.5) for _ in range(300)
    }
    return [(host, list(tokens), legacy) for host, tokens, legacy in own]


@pytest.mark.parametrize("least, containment, jaccard", [(4, 0.6, 0.5), (1, 0.0, 0.3), (2, 0.9, 0.1), (5, 0.5, 1.0)])
def test_against_all_pairs(spark, least, containment, jaccard):
    rows = made()
    want = {}
    for host, a, legacy in rows:
        for other, b, known in rows:
            if legacy and not known and host == other:
                n = len(set(a) & set(b))
                c, j = round(n / min(len(a), len(b)), 6), round(n / len(set(a) | set(b)), 6)
                if n >= least and c >= containment and j >= jaccard:
                    want[host, tuple(a), tuple(b)] = (n, c, j)
    table = spark.createDataFrame(rows + rows[:50], "host string, tokens array<string>, legacy boolean")
    got = audit.similar_titles(table, least, containment, jaccard).collect()
    assert {(r["host"], tuple(r["tokens"]), tuple(r["other_tokens"])): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_pairs_are_not_held(spark):
    """Pairs are not gathered to be told apart, which would take memory for all of a task."""
    table = spark.createDataFrame(made(), "host string, tokens array<string>, legacy boolean")
    plan = audit.similar_titles(table, 4, 0.6, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "other_tokens" in line]


def test_articles_are_sorted_once(spark, sf_dir):
    """An article is in the window of its own span alone; offers are what is repeated in those beside it."""
    from coverlake.plans import registry

    plan = registry.QUERIES["q51_url_drift"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Generate explode(sequence(")
    assert len(below) == 2 and "containment" not in below[1].split("\n", 1)[1]
