"""Key, domain and layout checks of the base tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.operators.joins import join_totals

#: Cells are padded by so much and are never wider than this.
PADDING, WIDEST = 4, 30


def short_hash(*values: Column | str) -> Column:
    """64 bits that stand for values where those that meet by chance are told apart afterwards."""
    return F.xxhash64(*values)


def pk_check(table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: number of rows, rows with a null in the key, keys that occur more than once.

    Rows are grouped by a 64-bit hash of the key, so however long the keys are, that and a count is all that is shuffled.
    Only the rows of a hash that occurs more than once, none in a sound table, are then grouped by the keys themselves,
    which tells repeated keys from hashes that met by chance.
    """
    has_null = reduce(lambda one, other: one | other, [F.col(key).isNull() for key in keys])
    hashed = table.select(*keys, F.when(~has_null, short_hash(*keys)).alias("_hash"))
    counts = hashed.groupBy("_hash").agg(F.count("*").alias("_rows"))
    whole = counts.agg(
        F.sum("_rows").alias("rows"),
        F.sum(F.when(F.col("_hash").isNull(), F.col("_rows"))).alias("nulls"),
        F.count_if(F.col("_hash").isNotNull() & (F.col("_rows") > 1)).alias("repeated"),
    ).first()
    duplicates = 0
    if whole["repeated"]:
        again = counts.where("_hash is not null and _rows > 1")
        suspects = join_totals(hashed.where("_hash is not null"), again, ["_hash"], "_rows")
        duplicates = suspects.groupBy(*keys).count().where("count > 1").count()
    row = (name, ",".join(keys), whole["rows"] or 0, whole["nulls"] or 0, duplicates)
    columns = "table_name string, key_columns string, row_count bigint, null_keys bigint, duplicate_keys bigint"
    return table.sparkSession.createDataFrame([row], columns)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key is absent from ``parent``."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def fk_check(child_keys: DataFrame, parent: DataFrame, key: str, child_name: str, parent_name: str) -> DataFrame:
    """One row: orphan keys and rows. ``child_keys`` holds one row per key with its row count in ``rows``.

    Counting per key before the join keeps the join as small as the key domain, so that a key shared by
    a large part of the child costs no more than any other.
    """
    return orphans(child_keys, parent, key).agg(
        F.lit(child_name).alias("child_table"),
        F.lit(parent_name).alias("parent_table"),
        F.lit(key).alias("key_column"),
        F.count("*").alias("orphan_keys"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
    )


def domain_check(table: DataFrame, rules: Mapping[str, Column], name: str) -> DataFrame:
    """One row per rule with the number of rows that break it, all counted in one pass."""
    counts = table.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations").select(
        F.lit(name).alias("table_name"), "rule", "violations"
    )


def column_profile(table: DataFrame) -> DataFrame:
    """Per column: display width, number of nulls and exact number of distinct values, all from one scan.

    Every value becomes a row of its column's number and a 64-bit hash; equal ones collapse before the only shuffle of
    more than a few rows. Each hash carries the least and greatest of a second, independent hash of its values: where
    they differ, two values met by chance, and the column's values under such hashes are counted by themselves.
    """
    columns = table.columns
    cells = [
        F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.when(F.col(f"`{column}`").isNotNull(), short_hash(F.col(f"`{column}`"))).alias("hash"),
            F.xxhash64(F.lit(ordinal), F.col(f"`{column}`")).alias("check"),
            F.length(F.col(f"`{column}`").cast("string")).alias("width"),
        )
        for ordinal, column in enumerate(columns, 1)
    ]
    hashes = (
        table.select(F.inline(F.array(*cells)))
        .groupBy("ordinal", "hash")
        .agg(
            F.count("*").alias("rows"),
            F.max("width").alias("width"),
            (F.min("check") != F.max("check")).alias("met"),
        )
    )
    met = F.col("met") & F.col("hash").isNotNull()
    found = hashes.groupBy("ordinal").agg(
        F.max("width").alias("width"),
        F.sum(F.when(F.col("hash").isNull(), F.col("rows"))).alias("nulls"),
        F.count("hash").alias("distincts"),
        F.count_if(met).alias("met"),
    )
    by_column = {row["ordinal"]: row for row in found.collect()}
    rows = []
    for ordinal, column in enumerate(columns, 1):
        row = by_column.get(ordinal)
        distincts = row["distincts"] if row else 0
        if row and row["met"]:
            value = F.col(f"`{column}`")
            among = hashes.where(met & (F.col("ordinal") == ordinal)).select("hash")
            values = table.select(value.alias("value"), short_hash(value).alias("hash")).join(among, "hash", "left_semi")
            distincts += values.where("value is not null").select("value").distinct().count() - row["met"]
        width = min(max(len(column), (row and row["width"]) or 0) + PADDING, WIDEST)
        rows.append((ordinal, column, width, (row and row["nulls"]) or 0, distincts))
    schema = "ordinal bigint, column_name string, width bigint, nulls bigint, distincts bigint"
    return table.sparkSession.createDataFrame(rows, schema)
