"""Chat formatting: tool calls linked with their results, ordered, checked against schemas, written as canonical JSON.

A message is a row (conv_id, turn, role, text). A call stands in a message whose text is a JSON object with ``tool_calls``, a
list of ``{"id", "name", "arguments"}``, and maybe ``content``; a result is a message whose text is a JSON object with
``tool_call_id`` and ``content``. Calls and results are hash-joined by (conv_id, id). A call waits for every call whose id its
arguments name as ``${id}``; calls are ordered by levels, level by level, and a call in or behind a circle gets none.
Arguments are checked against the parameters of the tool: unknown or missing ones, and types.

The result is one row per message, so that a conversation that holds a third of all rows gathers nowhere; ``turn`` and the
levels inside a message give the order. JSON is canonical: keys sorted, no white space, calls by (level, id).

Defined cases: a null text is written as null; text that is no such object, broken JSON included, is plain content. A call
without an id or name is no call and its message plain content. Of calls that share an id in a conversation the first
(by turn, then place) is linked, of results the first too; the others count as unlinked. Null conv_ids link nothing.
Repeated messages are messages of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.operators.storage import WorkTables

#: What a schema may ask of a value, and how Spark names the types of JSON values that pass.
KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*$", "array": "^ARRAY.*$", "null": "^VOID$", "any": "^.*$",
}


@dataclass(frozen=True)
class Parameter:
    """A parameter of a tool; a tool without parameters has one with an empty name."""

    tool: str
    name: str
    kind: str = "any"
    required: bool = True


#: The tools of ``op5_chats``.
TOOLS = [
    Parameter("search", "query", "string"),
    Parameter("search", "limit", "integer", required=False),
    Parameter("fetch", "url", "string"),
    Parameter("calculate", "expression", "string"),
]

_CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"


def parsed(messages: DataFrame) -> DataFrame:
    """Every message with a number, its calls and the id it answers, each null if there is none."""
    looks = F.coalesce(F.rlike("text", F.lit(r'^\s*\{[\s\S]*"tool_call')), F.lit(False))
    parts = F.when(looks & F.expr("try_parse_json(text) is not null"), F.from_json("text", _CALLS))
    calls = F.col("parts.tool_calls")
    good = (F.size(calls) > 0) & F.forall(calls, lambda c: c["id"].isNotNull() & c["name"].isNotNull())
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("message", F.monotonically_increasing_id())
    return rows.withColumn("parts", parts).select(
        "message",
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(good, calls).alias("calls"),
        F.when(F.col("parts.tool_call_id").isNotNull() & calls.isNull(), F.col("parts.tool_call_id")).alias("answers"),
        F.col("parts.content").alias("content"),
    )


def linked(rows: DataFrame) -> DataFrame:
    """Every call with the message of its result, if any: the first call and the first result of an id belong together."""
    calls = rows.select("message", "conv_id", "turn", F.posexplode("calls").alias("place", "call"))
    calls = calls.select("message", "conv_id", "turn", "place", "call.*")
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "message", "place")).alias("first"))
    calls = calls.join(first, ["conv_id", "id"], "left").withColumn(
        "is_first", F.coalesce(F.struct("turn", "message", "place") == F.col("first"), F.lit(False))
    )
    results = rows.filter("answers is not null").groupBy("conv_id", F.col("answers").alias("id"))
    results = results.agg(F.min(F.struct("turn", "message")).alias("result"))
    calls = calls.join(results, ["conv_id", "id"], "left")
    answer = F.when(F.col("is_first") & (F.col("result.turn") >= F.col("turn")), F.col("result.message"))
    return calls.withColumn("answer", answer).drop("first", "result")


def levelled(calls: DataFrame, tables: WorkTables) -> DataFrame:
    """Calls with ``level``: 0 without references, otherwise one more than the highest level they refer to."""
    names = F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$\{([^}]+)\}"), F.lit(1)))
    firsts = calls.filter("is_first")
    edges = firsts.select("conv_id", "id", F.explode(names).alias("needs"))
    known = firsts.select("conv_id", F.col("id").alias("needs"))
    edges = tables.save(edges.join(known, ["conv_id", "needs"]).distinct(), "edges")
    levels, level = [], 0
    while True:
        waiting = tables.save(edges.select("conv_id", "id").distinct(), "waiting")
        if waiting.isEmpty():
            break
        level += 1
        # what needs only calls that do not wait themselves is ready
        blocked = edges.join(waiting.withColumnRenamed("id", "needs"), ["conv_id", "needs"], "left_semi")
        ready = tables.save(waiting.join(blocked, ["conv_id", "id"], "left_anti"), "ready")
        if ready.isEmpty():
            levels.append(waiting.withColumn("level", F.lit(None).cast("int")).withColumn("waits", F.lit(True)))
            break
        levels.append(ready.withColumn("level", F.lit(level)).withColumn("waits", F.lit(True)))
        edges = tables.save(edges.join(ready, ["conv_id", "id"], "left_anti"), "edges")
    if not levels:
        return calls.withColumn("level", F.lit(0))
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    placed = calls.join(found, ["conv_id", "id"], "left")
    return placed.withColumn("level", F.when(F.col("waits"), F.col("level")).otherwise(0)).drop("waits")


def checked(calls: DataFrame, tools: Sequence[Parameter]) -> DataFrame:
    """Calls with ``problems``, a sorted list that is empty if the arguments fit the tool's schema."""
    listed = F.array(*(F.struct(F.lit(one.tool).alias("tool"), F.lit(one.name).alias("name"), F.lit(KINDS[one.kind]).alias("kind"), F.lit(one.required).alias("required")) for one in tools))
    own = F.filter(listed, lambda p: p["tool"] == F.col("name"))
    value = F.expr("try_parse_json(coalesce(arguments, '{}'))")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    given = F.when(is_object, F.map_entries(value.cast("map<string,variant>")))
    shapes = F.transform(given, lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("shape")))
    calls = calls.withColumn("own", own).withColumn("given", shapes)

    def same(key: Column) -> Column:
        return F.get(F.filter("own", lambda p: p["name"] == key), F.lit(0))

    wrong = F.transform(
        F.filter("given", lambda g: ~F.coalesce(F.rlike(g["shape"], same(g["key"])["kind"]), F.lit(False))),
        lambda g: F.concat(F.when(same(g["key"]).isNull(), F.lit("unknown:")).otherwise(F.lit("type:")), g["key"]),
    )
    missing = F.transform(
        F.filter("own", lambda p: p["required"] & (p["name"] != "") & ~F.exists("given", lambda g: g["key"] == p["name"])),
        lambda p: F.concat(F.lit("missing:"), p["name"]),
    )
    problems = (
        F.when(F.size("own") == 0, F.array(F.lit("no such tool")))
        .when(F.col("given").isNull(), F.array(F.lit("no object")))
        .otherwise(F.sort_array(F.concat(wrong, missing)))
    )
    return calls.withColumn("problems", problems).drop("own", "given")


def quoted(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    written = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(written, F.lit(2), F.length(written) - 2)).otherwise(F.lit("null"))


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; text that is no JSON becomes a string."""
    value = F.to_json(F.try_parse_json(json))
    return F.coalesce(value, quoted(json))


def serialised(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per message with its canonical JSON."""
    one = F.concat(
        F.lit('{"arguments":'), canonical(F.coalesce("arguments", F.lit("{}"))), F.lit(',"id":'), quoted(F.col("id")),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"linked":'),
        F.col("answer").isNotNull().cast("string"), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"problems":'),
        F.to_json("problems"), F.lit("}"),
    )
    made = calls.withColumn("json", one).groupBy("message").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "id", "place", "json"))).alias("made"),
        F.count("*").alias("n_calls"),
        F.count("answer").alias("n_linked"),
        F.count_if(F.size("problems") > 0).alias("n_invalid"),
    )
    answered = calls.filter("answer is not null").select(F.col("answer").alias("message"), F.lit(True).alias("links"))
    full = rows.join(made, "message", "left").join(answered, "message", "left")
    is_part = F.col("calls").isNotNull() | F.col("answers").isNotNull()
    content = F.when(is_part, F.col("content")).otherwise(F.col("text"))
    json = F.concat(
        F.lit('{"content":'), quoted(content), F.lit(',"role":'), quoted(F.col("role")),
        F.when(F.col("answers").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("answers")))).otherwise(F.lit("")),
        F.when(F.col("made").isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("made", lambda m: m["json"]), ","), F.lit("]"))).otherwise(F.lit("")),
        F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    none = F.lit(0).cast("bigint")
    return full.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("n_calls", none).alias("n_calls"),
        F.coalesce("n_linked", none).alias("n_linked"),
        F.coalesce("n_invalid", none).alias("n_invalid"),
        (F.col("answers").isNotNull() & F.col("links").isNull()).alias("orphan"),
        json.alias("json"),
    )


def formatted(messages: DataFrame, tables: WorkTables, tools: Sequence[Parameter] = TOOLS) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_linked, n_invalid, orphan, json) of every message."""
    rows = tables.save(parsed(messages), "messages")
    calls = checked(levelled(tables.save(linked(rows), "calls"), tables), tools)
    return serialised(rows, calls)
