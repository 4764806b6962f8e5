import random
from collections import Counter

import cases
import numpy as np
import pytest

from tillstone.llm import language
from tillstone.llm.language import Learning

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learned(documents, Learning(sample_per_language=150))
    known = {row["doc_id"]: row["lang"] for row in documents.select("doc_id", "lang").collect()}
    rows = [row for row in language.predicted(documents, model).collect() if row["held_out"]]
    assert len(rows) > 200
    assert np.mean([row["lang_pred"] == known[row["doc_id"]] for row in rows]) > 0.97
    assert (model.weights == 0).mean() > 0.5
    sure = [row["score"] for row in rows]
    assert 0 < min(sure) and max(sure) <= 1


def test_only_learnable_rows_matter(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 200")
    held = language.held_out(language.F.col("doc_id"))
    changed = documents.withColumn("lang", language.F.when(held, "xx").otherwise(language.F.col("lang")))
    options = Learning(sample_per_language=20)
    one, other = language.learned(documents, options), language.learned(changed, options)
    assert one.languages == other.languages
    assert (one.weights == other.weights).all()


def of_languages(spark, counts):
    """Rows of as many languages, each with words from four letters of its own."""
    source, rows = random.Random(5), []
    for at, count in enumerate(counts):
        letters = "".join(chr(0x4E00 + 4 * at + letter) for letter in range(4))
        rows += [(" ".join("".join(source.choices(letters, k=4)) for _ in range(20)), f"l{at:02}") for _ in range(count)]
    source.shuffle(rows)
    return spark.createDataFrame([(doc, *row) for doc, row in enumerate(rows)], "doc_id bigint, text string, lang string")


def test_a_frequent_language_is_learned(spark):
    documents, options = of_languages(spark, [2000, *[100] * 9]), Learning(sample_per_language=50)
    rows = language.sampled(language.learnable(documents), options)
    held, learned_from = (Counter(row["lang"] for row in part) for part in language.parted(rows, options))
    assert len(learned_from) == 10
    assert all(held[lang] == int((held[lang] + n) * 0.2) for lang, n in learned_from.items())
    known = {row["doc_id"]: row["lang"] for row in documents.collect()}
    found = language.predicted(documents, language.learned(documents, options)).collect()
    right = Counter(known[row["doc_id"]] for row in found if row["lang_pred"] == known[row["doc_id"]])
    assert right["l00"] > 1800 and all(right[f"l{at:02}"] > 80 for at in range(10))


def test_every_language_keeps_its_sample(spark):
    counts = [max(6, 3000 // (at + 1) ** 2) for at in range(20)]
    documents, options = of_languages(spark, counts), Learning(sample_per_language=60, sample_rows=200)
    rows = language.sampled(documents, options)
    taken = Counter(row["lang"] for row in rows)
    most = language.quota(counts, options)
    assert len(rows) <= 200 and sum(min(count, most) for count in counts) <= 200
    assert all(taken[f"l{at:02}"] == count for at, count in enumerate(counts) if count <= most)
    assert all(taken[f"l{at:02}"] >= most / 3 for at, count in enumerate(counts) if count > most)
    assert language.fitted(rows, np.ones(language.FEATURES), options).languages == [f"l{at:02}" for at in range(20)]


def test_languages_left_out_are_named(spark):
    with pytest.warns(UserWarning, match="^2 values of lang"):
        rows = language.sampled(of_languages(spark, [9, 8, 7, 6, 5]), Learning(languages=3))
    assert {row["lang"] for row in rows} == {"l00", "l01", "l02"}


def test_odd_documents(spark):
    rows = [(doc, text, "a" if at % 2 else "b") for at, (doc, text) in enumerate(cases.documents())] + [(77, "123 ... 456", "a")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.predicted(table, language.learned(table)).collect()
    assert len(found) == len(rows)
    texts = {doc: text for doc, text, _ in rows if doc is not None}
    for row in found:
        lettered = any(c.isalpha() for c in texts.get(row["doc_id"]) or ("x" if row["doc_id"] is None else ""))
        if row["doc_id"] is not None:
            assert (row["lang_pred"] == "und") == (not lettered)
        else:
            assert not row["held_out"]
        assert 0 <= row["score"] <= 1


def test_nothing_to_learn_from(spark):
    assert language.learned(cases.no_rows(spark)) is None
    found = language.predicted(cases.frame(spark), language.learned(cases.frame(spark))).collect()
    assert {(row["lang_pred"], row["score"]) for row in found} == {("und", 0.0)}
    assert language.predicted(cases.no_rows(spark), None).count() == 0


def test_temperature_lowers_the_loss():
    source = np.random.default_rng(0)
    scored = []
    for _ in range(500):
        logits = source.normal(size=3)
        scored.append((logits * 5, int(source.choice(3, p=language.softmax(logits)))))
    assert 3.5 < language.calibrated(scored) < 7
