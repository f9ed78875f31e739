"""Every registered query that has SQL, run by both engines over the smallest tables."""

import math

import pytest

from lumenq import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, data, con, name):
    got = queries.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [[plain(r[names.index(c)]) for c in columns] for r in want.fetchall()]
    assert sorted(map(repr, ([plain(r[c]) for c in columns] for r in got.collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_have_rows(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_the_entry_point_offers_all(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
