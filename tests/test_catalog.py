"""Every registered query of the library gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from specloom.plans import catalog, stores  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    said = duck.execute(catalog.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted(repr([plain(r[i]) for i in at]) for r in said.fetchall())
