"""Every query of the catalogue against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from tracemill import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def canonical(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(canonical, x))
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, tables, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(([canonical(r[c]) for c in columns] for r in df.collect()), key=str)
    cursor = tables.execute(catalog.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(([canonical(r[i]) for i in at] for r in cursor.fetchall()), key=str)
    assert found == expected
