"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docspark import registry

SF = "/root/testdata/sf0.001"
FOUND = registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted(columns), sorted((tuple(one(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in FOUND.items() if sql])
def test_same_as_sql(spark, duck, name):
    run, sql = FOUND[name]
    df = run(spark, SF)
    other = duck.execute(sql)
    columns = [c[0] for c in other.description]
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(other.fetchall(), columns)
