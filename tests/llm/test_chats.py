import json

from tillstone.llm import chats


def calls(*entries, **more):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), one, strict=False)) for one in entries], **more})


def answer(name, content="done"):
    return json.dumps({"tool_call_id": name, "content": content})


MESSAGES = [
    (1, 0, "user", 'quotes " and \\ and\nlines é \U0001f600'),
    (1, 1, "assistant", calls(("a", "search", {"query": "x", "limit": 3}), ("b", "fetch", {"url": "${a}"}), ("c", "fetch", {"link": 1}))),
    (1, 2, "tool", answer("a")),
    (1, 2, "tool", answer("a", "again")),
    (1, 3, "tool", answer("zz")),
    (1, 4, "assistant", calls(("d", "nope", {}), ("e", "search", {"query": "${f}"}), ("f", "search", {"query": "${e}"}), ("g", "search", {"query": "${b}", "z": 1}))),
    (1, 5, "assistant", calls(("a", "calculate", {"expression": "1"}), content="same id")),
    (1, 5, "tool", answer("b")),
    (2, 0, "assistant", calls(("a", "search", {"query": 1.5}))),
    (2, 0, "assistant", calls(("a", "search", "no object"))),
    (2, 1, "assistant", calls(("", "search", {"query": "x"}), ("h", None, {}))),
    (2, None, None, None),
    (None, 1, "user", '{broken "tool_calls"'),
    (None, 1, "assistant", calls(("a", "search", {"query": "x"}))),
    (None, 2, "tool", answer("a")),
    (3, 0, "user", '{"tool_calls": []}'),
    (3, 1, "user", ""),
    (3, 1, "user", ""),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def formatted(spark, tables, rows=MESSAGES):
    wide = [(*row, "x", "y") for row in rows]
    found = chats.formatted(spark.createDataFrame(wide, f"{SCHEMA}, message string, answers string"), tables).collect()
    for row in found:
        loaded = json.loads(row["json"])
        assert json.dumps(loaded, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == row["json"]
        assert (loaded["turn"], loaded["role"]) == (row["turn"], row["role"])
    return found


def test_messages(spark, tables):
    found = formatted(spark, tables)
    assert len(found) == len(MESSAGES)
    loaded = [(row["conv_id"], json.loads(row["json"]), row) for row in found]
    made = {(conv, one["id"], one["name"]): one for conv, message, _ in loaded for one in message.get("tool_calls", ())}
    state = {key: (one["level"], one["linked"], one["problems"]) for key, one in made.items() if key[0] == 1}
    assert state == {
        (1, "a", "search"): (0, True, []),
        (1, "b", "fetch"): (1, True, []),
        (1, "c", "fetch"): (0, False, ["missing:url", "unknown:link"]),
        (1, "d", "nope"): (0, False, ["no such tool"]),
        (1, "e", "search"): (None, False, []),
        (1, "f", "search"): (None, False, []),
        (1, "g", "search"): (2, False, ["unknown:z"]),
        (1, "a", "calculate"): (0, False, []),
    }
    order = [one["id"] for conv, message, _ in loaded if conv == 1 and message["turn"] == 1 for one in message["tool_calls"]]
    assert order == ["a", "c", "b"]
    assert sorted(row["orphan"] for conv, _, row in loaded if conv == 1 and row["role"] == "tool") == [False, False, True, True]
    problems = [one["problems"] for conv, message, _ in loaded if conv == 2 for one in message.get("tool_calls", ())]
    assert sorted(problems) == [["no object"], ["type:query"]]  # a call without a name is plain content
    assert not any(one["linked"] for conv, message, _ in loaded if conv is None for one in message.get("tool_calls", ()))
    contents = [message["content"] for conv, message, _ in loaded if conv == 3]
    assert sorted(contents) == ["", "", '{"tool_calls": []}']


def test_plain_conversations(spark, tables):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = chats.formatted(table, tables).collect()
    wanted = [
        json.dumps({"content": m["text"], "role": m["role"], "turn": m["turn"]}, separators=(",", ":"), ensure_ascii=False)
        for m in table.collect()
    ]
    assert sorted(row["json"] for row in rows) == sorted(wanted)


def test_empty_table(spark, tables):
    assert formatted(spark, tables, []) == []
