"""Every query of the catalogue: against DuckDB where SQL can express it, else that it runs."""

import math

import duckdb
import pytest

from skeinflow.plans import catalog
from skeinflow.plans import lifecycle as _lifecycle  # noqa: F401  registers its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value)[:19] if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    answer = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_are_chunked_whole(spark, tmp_path):
    """What follows the 5000th character of a page reaches both queries."""
    body = "filler words of the page. " * 300
    page = lambda end: f"<html><body>{body}{end}</body></html>"
    rows = [(1, "https://a.com/one", page(f"{catalog.QUERY} is what the end of the page speaks about.")), (2, "https://a.com/two", page("another end of the page."))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    chunks = catalog.QUERIES["entry_retrieval"](spark, str(tmp_path)).where("page_id = 1").select("chunk").collect()
    assert any("speaks about" in r[0] for r in chunks)
    hashes = {r[0] for r in catalog.QUERIES["page_cache"](spark, str(tmp_path)).select("content_hash").collect()}
    assert len(hashes) == 2
