"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerloom.plans import all_queries, all_twins
from ledgerloom.plans.fixtures import GIVEN, Fixture

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_twins()))
def test_twin(spark, duck, name):
    df = all_queries()[name](Fixture(spark, SF))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(all_twins()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_twins())))
def test_runs(spark, name):
    df = all_queries()[name](Fixture(spark, SF))
    assert df.columns and df.count() > 0
