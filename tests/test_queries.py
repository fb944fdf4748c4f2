"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(str([None if r[i] is None else float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(map(tuple, df.collect()), df.columns, sorted(columns)) == canon(cur.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first = sorted(map(str, QUERIES[name](spark, SF).collect()))
    assert first == sorted(map(str, QUERIES[name](spark, SF).collect()))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["anatomy"] for r in rows} == {1, 2, 3, 4}
    assert set(entry.oracle_sql()) <= set(entry.queries())
