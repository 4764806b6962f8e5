"""Allow and block rules on urls: a sorted sweep over reversed-host keys with a stack of open rules.

A rule is a host and a path prefix. It fits its host and every subdomain, where the url's path starts with the rule's;
of the rules that fit, the longest wins (then the one whose text is last). The canonical key of a host is its labels in
reverse, each followed by a dot: ``a.example.net`` becomes ``net.example.a.``. All hosts below a rule's host then lie in
one interval of keys, and intervals nest or are disjoint. Urls and rules are sorted together by key; the rule opened
last carries the stack of rules open at its place, those whose interval the url has left are taken off, and the longest
of the others whose path fits decides.

Every lane of the sweep gets an equal share of the urls, whatever their hosts, and all rules of a block; a rule set of
more than ``RULES_PER_SWEEP`` is swept in several blocks, so no lane holds more rules than that.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule. Ports and user names are
part of the host, as they stand. Repeated rows are judged one by one; of repeated rules one is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstone.operators.sizing import shuffle_partitions

RULES_PER_SWEEP = 10_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def end_of(key: Column) -> Column:
    """The first key after all keys that start with this one: its last dot becomes the next character, a slash."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def stacks(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(key, stack) of every host that has rules; stack: the rules of that host and of the hosts above it."""
    entries = [
        F.struct(F.lit(rule.host).alias("host"), F.lit(rule.path).alias("path"), F.lit(rule.verdict).alias("verdict"))
        for rule in rules
    ]
    listed = spark.range(1).select(F.explode(F.array(*entries)).alias("r")).select("r.*").distinct()
    listed = listed.withColumn("rule", F.concat("host", "path")).withColumn("key", key_of(F.col("host")))
    entry = F.struct(F.length("rule").alias("n"), "rule", "path", "verdict", end_of(F.col("key")).alias("end"))
    hosts = listed.groupBy("key").agg(F.collect_list(entry).alias("entries"))
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), "\\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("."))
    )
    nested = hosts.select("key", F.explode(above).alias("upper"))
    uppers = hosts.select(F.col("key").alias("upper"), "entries")
    return nested.join(uppers, "upper").groupBy("key").agg(F.flatten(F.collect_list("entries")).alias("stack"))


def sweep(urls: DataFrame, rules: DataFrame, lanes: int) -> DataFrame:
    """``urls`` (key, path, best, ...) with the longest fitting rule put into ``best`` if it beats what is there."""
    dealt = urls.withColumn("lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int"))
    dealt = dealt.withColumn("stack", F.lit(None).cast(rules.schema["stack"].dataType)).withColumn("is_url", F.lit(True))
    opened = rules.select("key", "stack", F.lit(False).alias("is_url"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    both = dealt.unionByName(opened, allowMissingColumns=True)
    so_far = Window.partitionBy("lane").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(so_far)).filter("is_url")
    fitting = F.filter(F.col("open"), lambda r: (F.col("key") < r["end"]) & F.startswith(F.col("path"), r["path"]))
    found = F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return swept.withColumn("best", F.greatest("best", F.array_max(found))).drop("lane", "stack", "open", "is_url")


def judged(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    lanes = shuffle_partitions(pages.sparkSession)
    urls = pages.select("page_id", "url")
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    urls = urls.withColumn("key", key_of(F.col("host"))).withColumn("best", none)
    for start in range(0, len(rules), RULES_PER_SWEEP):
        urls = sweep(urls, stacks(pages.sparkSession, rules[start : start + RULES_PER_SWEEP]), lanes)
    verdict = F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    return urls.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict)
