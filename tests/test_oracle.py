"""Every query against its SQL in another engine."""

import duckdb
import pytest

from brightshelf import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def comparable(rows):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


def text_key(rows):
    return sorted((tuple(map(str, r)) for r in comparable(rows)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, other, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in queries.SQL:
        assert rows
        return
    found = other.sql(queries.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert text_key(rows) == text_key([tuple(r[k] for k in at) for r in found.fetchall()])
