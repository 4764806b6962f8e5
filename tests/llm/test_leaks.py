import cases

from tillstone.llm import leaks


def windows(items):
    found = {}
    for item, text in items:
        words = cases.TERM.findall(cases.lowered(text))
        size = min(10, len(words))
        for at in range(len(words) - size + 1) if words else ():
            found.setdefault(tuple(words[at : at + size]), set()).add(item)
    return found


def expected(rows, items):
    known, result = windows(items), []
    sizes = {len(window) for window in known}
    for doc, text in rows:
        words, hit, named = cases.TERM.findall(cases.lowered(text)), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                items_here = known.get(tuple(words[at : at + size]), set())
                hit |= set(range(at, at + size)) if items_here else set()
                named |= {str(item) for item in items_here if item is not None}
        result.append((doc, len(words), len(hit), tuple(sorted(named))))
    return sorted(result, key=str)


def found(table):
    return sorted(((row["key"], row["n_words"], row["n_hit"], tuple(row["items"])) for row in table.collect()), key=str)


ITEMS = [
    (1, cases.prose(4, 60)),
    (2, " ".join(cases.prose(1, 120).split()[50:75])),
    (2, "one, two; three"),
    (10, "One two"),
    (None, " ".join(cases.prose(2, 30_000).split()[29_000:29_020])),
    (4, None),
    (5, "..."),
    (6, "a a a a a a a a a a a a"),
    (7, "absent terms only here and nowhere else at all in these documents"),
]


def test_odd_documents(spark, tables):
    rows = [*cases.documents(), (20, "a " * 25), (21, cases.prose(4, 60).replace(" ", "-").upper())]
    items = spark.createDataFrame([(*item, "x") for item in ITEMS], "item_id bigint, text string, words string")
    assert found(leaks.contamination(cases.frame(spark, rows), items, tables)) == expected(rows, ITEMS)


def test_small_segments(spark, tables, monkeypatch):
    monkeypatch.setattr(leaks, "SEGMENT_BYTES", 200)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert found(leaks.contamination(cases.frame(spark), items, tables)) == expected(cases.documents(), ITEMS)


def test_empty_tables(spark, tables):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leaks.contamination(cases.no_rows(spark), items, tables).count() == 0
    none = leaks.contamination(cases.frame(spark), items.filter("false"), tables)
    assert found(none) == expected(cases.documents(), [])


def test_proximity_takes_any_order(spark, tables):
    rows = [(1, "x red green y blue z"), (2, "blue x x x x x red green"), (3, "red green"), (4, None)]
    items = spark.createDataFrame([(1, "green red blue")], "item_id bigint, text string")
    near = leaks.proximity(cases.frame(spark, rows), items, 4, tables).collect()
    assert {row["key"]: row["items"] for row in near} == {1: ["1"], 2: [], 3: [], 4: []}
