"""The queries that have SQL give its rows on another engine, and every operator has its query."""

import os
import re

import duckdb
import pytest

from runloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_one_query_for_each_operator():
    assert [n for n in range(1, 14) if sum(bool(re.match(rf"op{n}_", name)) for name in queries.QUERIES) != 1] == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    done = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in done.description)
    at = [[d[0] for d in done.description].index(n) for n in names]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in done.fetchall())
