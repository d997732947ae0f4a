"""Every engine query against its SQL in DuckDB, over whole tables."""

import datetime
import os

import duckdb
import pytest

from mnemospark import queries as E

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, db, name):
    got = E.queries()[name](spark, SF)
    found = rows(got.columns, got.collect())
    if sql := E.oracle_sql().get(name):
        want = db.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert found == rows(columns, want.fetchall())
    else:
        assert found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
