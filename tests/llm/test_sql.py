"""Registered queries against their SQL."""

import duckdb
import pytest

from coverlake.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, out = QUERIES[name](spark, sf_dir), c.sql(ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(out.columns)
    rows = lambda names, values: sorted(tuple(dict(zip(names, r))[n] for n in order) for r in values)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(out.columns, out.fetchall())
