"""Every registered query of this part against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(tuple(str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query(spark, sql, name):
    got = Q.QUERIES[name](spark, SF)
    want = sql.sql(Q.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(map(tuple, got.select(*columns).collect())) == plain(tuple(r[k] for k in order) for r in want.fetchall())


def test_names_match():
    assert set(Q.ORACLE) <= set(Q.QUERIES) and len(Q.QUERIES) >= 40
