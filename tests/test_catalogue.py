"""Every query that has SQL gives the rows of that SQL."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from docloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf: str, duck, name: str) -> None:
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_entry(spark) -> None:
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
