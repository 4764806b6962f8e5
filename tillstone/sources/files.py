"""CSV and Parquet tables of the retail model, and report bundles."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstone.operators.storage import WorkTables


DATES = "yyyy-MM-dd"


def schema_of_header(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The declared columns in the order of a CSV's header; a missing or an unknown one is an error."""
    header = [name.strip() for name in spark.read.csv(path, header=True).columns]
    if sorted(header) != sorted(schema.names):
        missing, unknown = sorted(set(schema.names) - set(header)), sorted(set(header) - set(schema.names))
        raise ValueError(f"{path}: missing columns {missing}, unknown or repeated columns {unknown}")
    return T.StructType([schema[name] for name in header])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema, so no pass is spent on inferring types.

    Columns are taken by their names in the header, whatever their order. A value that does not fit its type fails the
    read instead of turning into a null.
    """
    in_file = schema_of_header(spark, path, schema)
    return spark.read.csv(path, schema=in_file, header=True, dateFormat=DATES, mode="FAILFAST").select(*schema.names)


REJECTED = "table_name string, file string, line string, reason string"


def _reason(line: Column, schema: T.StructType) -> Column:
    """Why a line does not fit: the first column whose text is not of its type, else the number of fields."""
    texts = F.from_csv(line, ", ".join(f"`{name}` string" for name in schema.names))

    def unfit(field: T.StructField) -> Column:
        text = texts.getField(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.lit(False)
        if isinstance(field.dataType, T.DateType):
            return text.isNotNull() & F.try_to_timestamp(text, F.lit(DATES)).isNull()
        return text.isNotNull() & text.try_cast(field.dataType).isNull()

    found = [F.when(unfit(field), f"{field.name} is no {field.dataType.simpleString()}") for field in schema.fields]
    return F.coalesce(*found, F.lit(f"not the {len(schema.fields)} fields of the header"))


def read_csv_apart(
    spark: SparkSession, path: str, schema: T.StructType, store: WorkTables, name: str,
    shaped: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV that fit the schema, and the lines that do not, with their file and the reason.

    The file is parsed once: what comes of it is written as columns, from which both tables are read. ``shaped`` may change
    the columns of the schema before they are written.
    """
    in_file = schema_of_header(spark, path, schema)
    broken = T.StructType([*in_file.fields, T.StructField("_line", T.StringType())])
    options = {"header": True, "dateFormat": DATES, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    parsed = spark.read.csv(path, schema=broken, **options).select(*in_file.names, "_line", F.col("_metadata.file_path").alias("_file"))
    parsed = store.save(shaped(parsed), f"{name}-parsed")
    rejected = parsed.where(F.col("_line").isNotNull()).select(
        F.lit(name).alias("table_name"), F.col("_file").alias("file"), F.col("_line").alias("line"),
        _reason(F.col("_line"), in_file).alias("reason"),
    )
    kept = [*schema.names, *parsed.columns]
    kept = [column for column in dict.fromkeys(kept) if column in parsed.columns and column not in ("_line", "_file")]
    return parsed.where(F.col("_line").isNull()).select(*kept), rejected


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def preview_csv(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    """First rows of a CSV of unknown schema, every column as text."""
    return spark.read.csv(path, header=True).limit(rows)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def write_parquet(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def write_bundle(
    tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", parallelism: int = 4
) -> dict[str, str]:
    """Write named report tables side by side, one directory each; returns their paths.

    Most reports are too small to fill a cluster, so several are written at a time.
    """
    if not tables:
        return {}
    write = {"parquet": write_parquet, "csv": write_csv}[fmt]
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    session = next(iter(tables.values())).sparkSession
    task = inheritable_thread_target(session)(lambda name: write(tables[name], paths[name]))
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(task, tables))
    return paths


def publish_table(table: DataFrame, database: str, name: str) -> str:
    """Make a table readable as ``database.name``, at once and as a whole; returns the folder of this version.

    The rows are written to a folder of their own below the database. Only then is the catalog's view of that name moved
    to it, which is one step: a reader sees the version before or this one, and a write that fails changes nothing. The
    version before stays for readers that have begun; older ones are deleted.
    """
    spark = table.sparkSession
    home = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{name}-versions"
    path = f"{home}/{time.time_ns():020}"
    table.write.parquet(path)
    if spark.catalog.tableExists(f"{database}.{name}") and spark.catalog.getTable(f"{database}.{name}").tableType != "VIEW":
        spark.sql(f"drop table {database}.{name}")  # of an earlier layout
    spark.sql(f"create or replace view {database}.{name} as select * from parquet.`{path}`")
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(str(status.getPath().getName()) for status in files.listStatus(folder))
    for version in versions[:-2]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{version}"), True)
    return path


def save_tables(tables: Mapping[str, DataFrame], database: str) -> None:
    """Publish tables in a database, in the order given (parents before children)."""
    for name, table in tables.items():
        publish_table(table, database, name)
