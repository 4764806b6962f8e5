import cases
import test_leaks
import test_near_dedup
import test_packing
import test_quality

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(table):
    return sorted(((row["doc_id"], row["text"]) for row in table.select("doc_id", "text").collect()), key=str)


def benchmark_folder(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_over_the_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = rows_of(docs), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packed_sequences":
            assert test_packing.check(before, docs.collect()) == 0
            break
        assert docs.columns == columns
        assert docs.filter("n_chars <> length(text)").isEmpty()
        after = rows_of(docs)
        if name == "quality_rules":
            failed = {doc for doc, text in before if test_quality.measures(text)[-1]}
            assert not failed & {doc for doc, _ in after}
        if name == "near_duplicates":
            groups = components_of(before)
            assert after == [row for row in before if row[0] == groups[row[0]]]
        if name == "benchmark_leaks":
            items = [tuple(row) for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            hit = {doc for doc, _, n_hit, _ in test_leaks.expected(before, items) if n_hit}
            assert hit and after == [row for row in before if row[0] not in hit]
        before = after


def components_of(rows):
    """doc_id -> least doc_id of its component, by an inverted index over all shingles."""
    sets = {doc: test_near_dedup.shingles(text) for doc, text in rows}
    holders, common, label = {}, {}, {doc: doc for doc in sets}
    for doc, found in sets.items():
        for shingle in found:
            holders.setdefault(shingle, []).append(doc)
    for docs in holders.values():
        for a in docs:
            for b in docs:
                if b < a:
                    common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {doc: new if one == old else one for doc, one in label.items()}
    return label


def test_odd_documents_go_through(spark, tmp_path):
    """A clean document is left at the end, and each stage leaves what plain Python does."""
    folder = benchmark_folder(spark, tmp_path, test_leaks.ITEMS)
    clean = (99, f"{cases.prose(77, 90)}.")
    rows = [(doc, text and f"{text}.") for doc, text in cases.documents()] + [clean]
    docs, left = cases.frame(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packed_sequences":
            left[name] = rows_of(docs)
            assert clean in left[name]
    failed = {text for _, text in rows if test_quality.measures(text or "")[-1]}
    assert not failed & {text for _, text in left["quality_rules"]}
    hit = {(doc, n_words) for doc, n_words, n_hit, _ in test_leaks.expected(left["repeated_passages"], test_leaks.ITEMS) if n_hit}
    assert hit
    words = lambda text: len(cases.TERM.findall(cases.lowered(text)))
    assert left["benchmark_leaks"] == [row for row in left["repeated_passages"] if (row[0], words(row[1])) not in hit]
    assert test_packing.check(left["benchmark_leaks"], docs.collect()) == 0


def test_empty_tables_go_through(spark, tmp_path):
    folder = benchmark_folder(spark, tmp_path, [])
    docs = cases.no_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}") if name != "packed_sequences" else docs
        assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
