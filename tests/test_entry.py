"""The driver's entry: names, SQL and the smoke query."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["clean_funnel", "redacted", "document_offsets", "padded_batches", "top_p"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(str, map(key, (tuple(r) for r in df.select(*cols).collect())))) == sorted(map(str, map(key, want)))
