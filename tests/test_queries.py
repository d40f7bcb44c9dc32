"""Every registered query with SQL against DuckDB at the smallest scale; the others must give rows."""

import duckdb
import pytest

from cohortlake.queries import oracle_sql, queries
from cohortlake.sources.readers import TABLES

QUERIES, SQL = queries(), oracle_sql()


def written(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(written(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(written(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
