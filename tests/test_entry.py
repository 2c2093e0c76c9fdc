"""Every query against its SQL, on the smallest test tables where they are there."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("ARCWEAVE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.columns, got) == comparable(columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["seed_id", "src_id", "dst_id", "ts"]
