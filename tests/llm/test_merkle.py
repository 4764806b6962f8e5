import zlib
from hashlib import sha256

import cases
import pytest
from pyspark.sql import functions as F

from tillstone.llm import merkle, registry

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **changed):
    row = row | changed
    values = (row[name] for name in merkle.FIELDS)
    return H(*("-" if value is None else f"{len(str(value).encode())}:{value}" for value in values))


def tree(nodes):
    """Root and, for every node, its path: (own place in the run, the run's others) per level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place - place % 2 : place - place % 2 + 2]
            paths[i].append((place % 2, [one for j, one in enumerate(run) if j != place % 2]))
        at = [place // 2 for place in at]
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def fold(node, path):
    for place, others in path:
        node = H(*others[:place], node, *others[place:])
    return node


def expected(rows):
    """One tuple per row, by plain Python."""
    langs = {}
    for row in rows:
        langs.setdefault(row["lang"], []).append(row)
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda row: (row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
        trees[lang] = tree([leaf_of(row) for row in langs[lang]])
    root, tops = tree([trees[lang][0] for lang in order]) if order else (None, [])
    made = []
    for lang, top in zip(order, tops, strict=True):
        subroot, paths = trees[lang]
        for row, path in zip(langs[lang], paths, strict=True):
            own, full = leaf_of(row), path + top
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
            folded = fold(leaf_of(row, n_chars=row["n_chars"] + 1) if hit else own, full)
            proof = H(*(other for _, others in full for other in others))
            made.append((row["doc_id"], own, subroot, root, proof, folded, folded == root))
    return made


def check(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [row.asDict() for row in table.select(*merkle.FIELDS).collect()]
    found = registry.op12_merkle(spark, str(tmp_path))
    assert found.columns == list(NAMES)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows), key=str)
    return rows


def documents(spark, counts, seed=0):
    rows = []
    for lang, count in counts.items():
        rows += [(len(rows) * 7 % 5000 + at, cases.prose(at + seed, at % 5), lang, f"s{at % 3}" if at % 4 else None, at if at % 6 else None) for at in range(count)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 2}, {"en": 3, None: 1}, {"en": 5, "": 4, "é": 9, "z": 1, None: 17}])
def test_small_trees(spark, tmp_path, counts):
    check(spark, tmp_path, documents(spark, counts).repartition(3))


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_blocks_smaller_than_trees(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rows = check(spark, tmp_path, documents(spark, {"en": 203, "de": 64, None: 65, **{f"l{at}": 1 + at % 3 for at in range(21)}}).repartition(4))
    assert len(rows) > 350


def test_odd_documents(spark, tmp_path):
    rows = [(doc, text, lang, source, size) for (doc, text), lang, source, size in zip(
        cases.documents(), [None, "en", "En", ""] * 9, ["a", None] * 15, [None, 3, 9223372036854775807, -1] * 9)]
    frame = spark.createDataFrame(rows * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    more = {name: F.lit("x") for name in ("tree", "POS", "leaf", "node", "place", "part")}
    check(spark, tmp_path, frame.withColumns(more))


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, documents(spark, {"en": 1}).limit(0))


def test_whole_table(spark, tmp_path):
    rows = check(spark, tmp_path, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(not row[-1] for row in expected(rows))


def test_tampering_is_found(spark, tables):
    frame = documents(spark, {"en": 40, "de": 3})
    honest = merkle.manifest(frame, tables)
    assert honest.proofs.filter("verified").count() == 43
    other = merkle.manifest(frame, tables, {"text": F.concat("text", F.lit("."))}, F.col("doc_id") % 2 == 0)
    assert other.root == honest.root
    assert other.proofs.filter("verified = (doc_id % 2 = 0)").isEmpty()
    assert [tuple(row) for row in honest.trees.orderBy("tree").collect()] == [("de", 0, 3), ("en", 1, 40)]
