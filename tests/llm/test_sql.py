"""Operators that SQL can say, against DuckDB."""

import duckdb
import pytest

from linkwright.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == sorted(tuple(str(r[want.columns.index(n)]) for n in names) for r in want.fetchall())
