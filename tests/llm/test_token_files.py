import zlib

import cases
import numpy as np
import public_tokenizers
from pyarrow import fs
from tokenizers import Tokenizer

from tillstone.llm import token_files
from tillstone.llm.token_files import Corpus, TokenFormat

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(rows, closing=2):
    return [(doc, TOKENIZER.encode(text or "", add_special_tokens=False).ids + [closing]) for doc, text in rows]


def check(rows, manifest):
    """Whatever the order of rows that share a doc_id, the files hold every document whole, in ascending order."""
    found = sorted(map(tuple, token_files.read_tokens(manifest, with_ids=True).collect()), key=lambda row: row[1])
    wanted = encoded(rows)
    assert sorted(map(str, ((doc, ids) for doc, *_, ids in found))) == sorted(map(str, wanted))
    order = [(doc is not None, doc or 0) for doc, *_ in found]
    assert order == sorted(order)
    start = 0
    for _, at, size, crc, ids in found:
        assert (at, size) == (start, len(ids)) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += size
    corpus, flat = Corpus(manifest), [one for row in found for one in row[-1]]
    assert corpus.size == len(flat)
    for span in (slice(0, len(flat)), slice(5, 5), slice(len(flat) // 3, 2 * len(flat) // 3), slice(len(flat) - 1, None)):
        assert corpus[span].tolist() == flat[span]


def test_odd_documents(spark, tables):
    check(cases.documents(), token_files.write_tokens(cases.frame(spark), tables))


def test_many_shards(spark, tables, settings):
    settings(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="7")
    rows = [(doc * 37 % 400 if doc % 9 else None, cases.prose(doc, doc % 60)) for doc in range(400)]
    manifest = token_files.write_tokens(cases.frame(spark, rows).repartition(5), tables)
    assert manifest.count() > 3
    check(rows, manifest)


def test_one_row_many_times(spark, tables, settings):
    settings(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="5")
    rows = [(7, "the same text")] * 900 + [(doc, f"text {doc}") for doc in range(100)]
    folder = f"{tables.folder}/documents"
    cases.frame(spark, rows, extra=False).repartition(4).write.parquet(folder)
    manifest = token_files.write_tokens(spark.read.parquet(folder), tables)
    assert max(row["documents"] for row in manifest.collect()) < 500
    check(rows, manifest)


def test_files_are_flat(spark, tables):
    manifest = token_files.write_tokens(cases.frame(spark, [(2, "two words"), (1, "one")], extra=False).coalesce(1), tables)
    ids, offsets, docs = [], [], []
    for row in sorted(manifest.collect(), key=lambda row: row["part"]):
        for name, kind, found in ((f"{row['shard']}.ids", "<u2", ids), (row["offsets"], "<u8", offsets), (f"{row['shard']}.docs", "<i8", docs)):
            system, path = fs.FileSystem.from_uri(name)
            found.append(np.frombuffer(system.open_input_file(path).read(), kind).tolist())
    (_, one), (_, two) = encoded([(1, "one"), (2, "two words")])
    assert sum(ids, []) == one + two and sum(docs, []) == [1, 2]
    assert sorted(set(sum(offsets, []))) == [0, len(one), len(one + two)]


def test_wide_ids(spark, tables):
    manifest = token_files.write_tokens(cases.frame(spark, [(1, "a")], extra=False), tables, TokenFormat(closing_id=70_000))
    (row,) = token_files.read_tokens(manifest, with_ids=True).collect()
    assert row["ids"][-1] == 70_000 and manifest.first()["width"] == 4


def test_empty_table(spark, tables):
    manifest = token_files.write_tokens(cases.no_rows(spark), tables)
    assert manifest.count() == 0 and token_files.read_tokens(manifest).count() == 0 and Corpus(manifest).size == 0


def test_whole_table(spark, tables):
    rows = [tuple(row) for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(rows, token_files.write_tokens(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tables))
