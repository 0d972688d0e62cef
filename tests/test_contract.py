import duckdb
import pytest

import __spark_entry__ as contract
from nearword import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "lat", "lon", "score"]
    assert set(contract.oracle_sql()) <= set(contract.queries())


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-9
    return a == b


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = engine.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    expected = duck.sql(engine.ORACLE_SQL[name])
    assert sorted(expected.columns) == names
    order = lambda rows: sorted(rows, key=lambda r: [str(round(x, 6) if isinstance(x, float) else x) for x in r])
    ours = order(tuple(r) for r in found.select(names).collect())
    theirs = order(duck.sql(f"SELECT {', '.join(names)} FROM ({engine.ORACLE_SQL[name]})").fetchall())
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_seeded_queries_repeat(spark, name):
    a, b = (engine.QUERIES[name](spark, SF).collect() for _ in range(2))
    assert a == b and a
