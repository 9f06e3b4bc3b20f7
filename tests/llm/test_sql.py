"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from skeinflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    answer = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr) == want
