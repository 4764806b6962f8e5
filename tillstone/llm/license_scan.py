"""License scan: ordered signature rules behind a keyword prefilter, overlaps settled by rank and containment.

Texts become words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) with one space between. Only texts that hold
one of the rules' keywords are looked at further, and only by the rules whose keyword they hold. All places of a rule
are intervals of words. A detection is given up if another one of its rank or a better one covers its interval (of two
over the same words and of one rank, the earlier rule stays). Base phrases are counted and named in any case.

Defined cases: a null text is an empty one, with no words and no labels. Each row is scanned by itself, whether or not
its doc_id is null or repeated. The work on a row's detections is sorted, not quadratic, so very long texts with
thousands of places are no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.llm.license_rules import KEYWORDS, MENTIONED, signatures
from tillstone.operators.sizing import shuffle_partitions
from tillstone.operators.storage import WorkTables

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_count(words: Column) -> Column:
    """Words of a text that is separated by single spaces, maybe with spaces around it."""
    held = F.trim(words)
    return F.when(held == "", 0).otherwise(F.length(held) - F.length(F.replace(held, F.lit(" "), F.lit(""))) + 1)


def prepared(documents: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, words); words: the separated text, null if no keyword occurs."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS, " ")), F.lit(" "))
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    gate = F.lit(False)
    for keyword in KEYWORDS:
        gate = gate | F.contains("words", F.lit(keyword))
    return numbered.select("row", "doc_id", word_count(F.col("words")).cast("bigint").alias("n_words"), F.when(gate, F.col("words")).alias("words"))


def detections(texts: DataFrame) -> DataFrame:
    """(row, rule, label, rank, score, base, first, last) of every place of every rule in ``texts`` (row, words)."""
    rules = F.array(
        *(
            F.struct(
                F.lit(number).alias("rule"),
                F.lit(one.label).alias("label"),
                F.lit(one.rank).alias("rank"),
                F.lit(one.keyword).alias("keyword"),
                F.lit(one.pattern).alias("pattern"),
                F.lit(one.score).alias("score"),
                F.lit(one.base).alias("base"),
            )
            for number, one in enumerate(signatures())
        )
    )
    held = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda keyword: F.contains("words", keyword))
    gated = texts.withColumn("held", held)
    gated = gated.select("row", "words", F.explode(F.filter(rules, lambda r: F.array_contains("held", r["keyword"]))).alias("r"))
    found = F.regexp_extract_all("words", F.col("r.pattern"), F.lit(0))
    places = gated.withColumn("found", found).filter(F.size("found") > 0)
    pieces = F.arrays_zip(F.split("words", F.col("r.pattern"), -1).alias("before"), F.col("found").alias("match"))
    placed = places.select("row", "r", F.posexplode(pieces).alias("place", "piece")).filter("piece.match is not null")
    so_far = Window.partitionBy("row", "r.rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = word_count(F.col("piece.match"))
    last = F.sum(word_count(F.col("piece.before")) + size).over(so_far) - 1
    return placed.select("row", "r.rule", "r.label", "r.rank", "r.score", "r.base", last.alias("last"), size.alias("size")).selectExpr(
        "row", "rule", "label", "rank", "score", "base", "last - size + 1 first", "last"
    )


def surviving(found: DataFrame) -> DataFrame:
    """``found`` with ``stays``: no detection of the same or a better rank covers this one."""
    before = (
        Window.partitionBy("row")
        .orderBy("first", F.desc("last"), "rank", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.lit(False)
    for rank in range(MENTIONED + 1):
        reach = F.max(F.when(F.col("rank") <= rank, F.col("last"))).over(before)
        covered = F.when(F.col("rank") == rank, F.coalesce(reach >= F.col("last"), F.lit(False))).otherwise(covered)
    return found.withColumn("stays", ~covered)


def license_scan(documents: DataFrame, tables: WorkTables) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): counts, base labels, all labels and the best score."""
    texts = tables.save(prepared(documents), "words")
    # few texts pass the gate, but each is work for many rules: deal them out anew
    gated = texts.filter("words is not null").select("row", "words").repartition(shuffle_partitions(texts.sparkSession), "row")
    found = surviving(detections(gated))
    names = lambda kept: F.array_join(F.sort_array(F.collect_set(F.when(kept, F.col("label")))), ",")
    per_row = found.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("base") | F.col("stays")).alias("labels"),
        F.max(F.when(F.col("stays"), F.col("score"))).alias("score"),
    )
    return texts.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
