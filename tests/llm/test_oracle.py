"""The queries that SQL can express, on the whole tables."""

import compare
import duckdb
import pytest

from tillstone.llm.oracle import ORACLE_SQL
from tillstone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    columns, kinds, rows = compare.spark_rows(QUERIES[name](spark, FOLDER))
    with duckdb.connect() as con:
        for table in ("documents", "benchmark", "pages", "embeddings"):
            con.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
        other_columns, _, other_rows = compare.oracle_rows(con, ORACLE_SQL[name])
    assert compare.canonical(columns, rows) == compare.canonical(other_columns, other_rows)
