"""Every query with SQL gives DuckDB's rows at the smallest scale; the others run."""

import decimal
import os

import duckdb
import pytest

from groundwork.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows_of(df.select(columns).collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == rows_of([r[k] for k in at] for r in want.fetchall())


def test_entry_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert catalogue.queries().keys() <= __spark_entry__.queries().keys()
    assert os.path.isdir(SF)
