"""Every query of the core library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from echofold.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = catalogue.queries()[name](spark, DIR)
    want = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_flagship():
    assert catalogue.FLAGSHIP in catalogue.queries() and catalogue.queries().keys() == catalogue.oracle_sql().keys()
