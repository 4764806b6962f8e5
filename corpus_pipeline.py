"""A training corpus in five stages: quality rules, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.llm import leaks, near_dedup, packing, quality, repeats
from tillstone.llm.arrow import Held
from tillstone.operators.storage import WorkTables

#: Work tables of the stage called last. Its result is written before the next stage runs, which then drops them.
_left: list[WorkTables] = []


def work_tables(spark: SparkSession, docs: DataFrame) -> WorkTables:
    """Tables for a new stage; those of the stage before go, unless ``docs`` still reads them."""
    read = docs.inputFiles()
    for tables in [*_left]:
        name = tables.folder.rpartition("/")[2]
        if tables.spark is spark and not any(name in path for path in read):
            tables.drop()
        _left.remove(tables)
    _left.append(WorkTables(spark))
    return _left[-1]


def with_text(held: Held, rows: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    now = {"n_chars": F.length(held["text"]).cast("bigint")} if "n_chars" in held.columns else {}
    return held.restored(rows, **now)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; documents that are rejected go."""
    work_tables(spark, docs)
    held, rows = quality.judged(docs)
    return with_text(held, rows.filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.deduplicated(docs, work_tables(spark, docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut out; documents without a word left go."""
    held, rows = repeats.without_repeats(docs, work_tables(spark, docs))
    return with_text(held, rows.filter(F.rlike(held["text"], F.lit("[^\\x20\\x09-\\x0D]"))))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    tables, held = work_tables(spark, docs), Held(docs)
    rows = tables.save(held.table.withColumn("row", F.monotonically_increasing_id()), "rows")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = rows.select("row", F.col(held["text"]).alias("text"))
    found = leaks.contamination(texts, benchmark, tables, "row")
    hit = tables.save(found.filter("n_hit > 0").select(F.col("key").alias("row")), "hit")
    return held.restored(rows.join(hit, "row", "left_anti"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.packed(docs, work_tables(spark, docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed_sequences", packed_sequences),
]

#: Tokenizers and rolling hashes are beyond SQL; ``tests/llm`` holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = WorkTables(spark)
    for name, stage in STAGES[:-1]:
        docs = between.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
