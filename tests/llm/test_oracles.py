"""The contract queries with SQL, over whole tables."""

import duckdb
import pytest

from mnemospark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = c.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = Q.queries()[name](spark, sf_dir).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 14)}
