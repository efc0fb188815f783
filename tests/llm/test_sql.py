"""The newest corpus queries against their SQL in another engine."""

import duckdb
import pytest

from brightshelf.llm import queries as Q


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_fill_in_middle"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df, found = Q.queries()[name](spark, small), con.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)
