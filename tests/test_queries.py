import re

import pytest

import __spark_entry__ as entry

TABLES = "documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline", n)]


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if x is None or x != x else float(x) if isinstance(x, (int, float)) else str(x) for x in r]) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, data, name):
    ours = entry.queries()[name](spark, data).toPandas()
    if name in entry.oracle_sql():
        theirs = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)
    assert len(ours)


def test_entry(spark, data):
    assert entry.entry(spark).count() == 4


def test_sql_is_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
