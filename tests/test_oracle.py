"""Every query with an oracle against DuckDB on the same tables; the others run and have a stable schema."""

import math
import os

import duckdb
import pytest

from loomspan import plans

QUERIES, ORACLE = plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if v is None or isinstance(v, (str, bool)):
        return v
    return float(v) if isinstance(v, int) else str(v)


def rows(data, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(value(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE[name])
    assert sorted(expected.columns) == columns
    assert rows([tuple(r) for r in df.collect()], columns, df.columns) == rows(expected.fetchall(), columns, expected.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
