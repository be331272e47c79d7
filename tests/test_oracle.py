"""Every registered query of the library runs, and equals its SQL in DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

from corpusmill.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        expected = duck.sql(ORACLE_SQL[name])
        order = [expected.columns.index(c) for c in columns]
        assert sorted(expected.columns) == columns
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in expected.fetchall()), key=repr)
