"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def oracle_rows(con, sql: str):
    result = con.execute(sql)
    columns = [entry[0] for entry in result.description]
    types = {entry[0]: str(entry[1]).upper() for entry in result.description}
    return columns, types, result.fetchall()


def spark_rows(table):
    return table.columns, dict(table.dtypes), [tuple(row) for row in table.collect()]


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: [(value is not None, str(type(value)), value) for value in row]
    return [columns[i] for i in order], sorted(([row[i] for i in order] for row in rows), key=key)
