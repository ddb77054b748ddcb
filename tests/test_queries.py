import os
from collections import Counter

import duckdb
import plumbline.queries_tables  # noqa: F401  adds its queries
import pytest
from plumbline.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


#: Views in which nothing of the kind need be there.
MAY_BE_EMPTY: set[str] = set()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have or name in MAY_BE_EMPTY
    if name in SQL:
        got = con.sql(SQL[name])
        assert sorted(got.columns) == sorted(df.columns)
        want = rows(got.columns, got.fetchall())
        assert have == want, (list((have - want).items())[:4], list((want - have).items())[:4])
