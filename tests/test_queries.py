"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from linkwright.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    plain = lambda v: round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, list) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


@pytest.mark.parametrize("name", "n01_fold_lookalikes n02_fold_diacritics n03_normalize_variants n13_trigrams n14_unique_trigrams n15_signature".split())
def test_whole_texts_are_used(spark, duck, sf_dir, name):
    """More comes out than of first sentences."""
    size = lambda n: sum(r[1] if isinstance(r[1], int) else len(r[1]) for r in QUERIES[n](spark, sf_dir).collect())
    assert size(f"{name}_whole") > 3 * size(name)
    assert QUERIES[f"{name}_whole"](spark, sf_dir).count() == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("g0") and n.endswith("_whole")])
def test_every_part_has_a_pair(spark, duck, sf_dir, name):
    got = [r.k for r in QUERIES[name](spark, sf_dir).collect()]
    assert sorted(got) == [k for (k,) in duck.sql("SELECT p_partkey FROM part ORDER BY 1").fetchall()]


def test_result_page_has_rows(spark, duck, sf_dir):
    got = [tuple(r) for r in QUERIES["l05_result_page_whole"](spark, sf_dir).collect()]
    assert len(got) == 20 and got == duck.sql(ORACLES["l05_result_page_whole"]).fetchall()
