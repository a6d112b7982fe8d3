"""Every registered query of the library against its SQL in DuckDB."""

import math

import duckdb
import pytest

from graphloom.plans import registry
from graphloom.plans.demo import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert ours == sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
