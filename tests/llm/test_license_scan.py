import cases
import pytest

from tillstone.llm.license_rules import BASE, KEYWORDS, signatures
from tillstone.llm.license_scan import license_scan


def base(text):
    words, places, labels = cases.TERM.findall(cases.lowered(text)), [], set()
    for phrase, label in BASE:
        parts = phrase.split()
        found = [at for at in range(len(words)) if words[at : at + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(spark, rows, tables):
    return license_scan(cases.frame(spark, rows), tables).collect()


def test_base_on_odd_documents(spark, tables):
    texts = [
        "CC BY cc-by; cc,by cc. all Rights\nreserved GENERAL PUBLIC LICENSE general public licenses",
        "cc by cc by cc by",
        ("word " * 50 + "all rights reserved ") * 300,
        "éall rights reserved all rights reservedé all rights reserved",
    ]
    rows = cases.documents() + [(100 + at, text) for at, text in enumerate(texts)] + [(100, texts[0])]
    found = scan(spark, rows, tables)
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found]
    assert sorted(got, key=str) == sorted([(doc, *base(text)) for doc, text in rows], key=str)
    for row in found:
        assert 0 <= row["score"] <= 1
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))


CASES = {
    "Licensed under the GNU General Public License, version 3 or any later version": "gpl,gpl-3.0,licensed",
    "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "Released under the MIT License.": "licensed,mit",
    "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0",
    "https://creativecommons.org/licenses/by/3.0/": "cc-by-3.0",
    "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
    "LGPLv3, MPL 1.1": "lgpl-3.0,mpl-1.1",
    "a permission slip, reserved seats and a licence to drive": "",
    "the 3-clause BSD license": "bsd,bsd-3-clause",
    "CC0 1.0": "cc0",
}


def test_labels(spark, tables):
    rows = list(enumerate(CASES))
    found = {row["doc_id"]: row["labels"] for row in scan(spark, rows, tables)}
    assert {text: found[at] for at, text in rows} == CASES


TAGGED = {
    "// SPDX-License-Identifier: MIT": "mit",
    "/* SPDX-License-Identifier: ISC */": "isc",
    "# SPDX-License-Identifier: Zlib": "zlib",
    "SPDX-License-Identifier: Unlicense": "unlicense",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: MS-PL": "ms-pl",
    "SPDX-License-Identifier: MIT-0": "",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify": "unlicense",
}


def test_tags_without_versions(spark, tables):
    found = {row["doc_id"]: row["labels"] for row in scan(spark, list(enumerate(TAGGED)), tables)}
    assert {text: found[at] for at, text in enumerate(TAGGED)} == TAGGED


def test_hundreds_of_rules_behind_keywords():
    rules = signatures()
    assert len(rules) > 300
    assert {rule.keyword for rule in rules} <= set(KEYWORDS)


def test_empty_table(spark, tables):
    assert scan(spark, [], tables) == []


@pytest.mark.parametrize("query", ["license_scan", "urls", "chats"])
def test_no_python_in_the_plan(spark, tables, query):
    from tillstone.llm import chats, url_filter

    if query == "license_scan":
        table = license_scan(cases.frame(spark), tables)
    elif query == "urls":
        table = url_filter.judged(spark.sql("select 1L page_id, 'http://a.net/' url"), [url_filter.Rule("block", "net")])
    else:
        table = chats.formatted(spark.sql("select 1L conv_id, 0L turn, 'user' role, 'x' text"), tables)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
