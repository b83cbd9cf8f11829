"""The training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lexiloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(df.select(*columns).collect()) == plain(want.select(*columns).fetchall())
